"""Language ID, edit fingerprints, the Jaccard join and components against plain Python."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkscour.llm import edit_fingerprints as E
from sparkscour.llm import jaccard_tiles as J
from sparkscour.llm import string_kernel as K
from sparkscour.llm.components import components
from tests.llm.cases import awkward, document, frame, words

SYLLABLES = {"aa": "ka lo mi tu re".split(), "bb": "sch ein ung der ö".split(), "cc": "что при это да".split()}


def speech(rnd, lang, n=60):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randrange(1, 5))) for _ in range(n))


def labelled(seed, n=90):
    rnd = random.Random(seed)
    return [document(i, speech(rnd, lang), lang) for i, lang in enumerate(sorted(SYLLABLES) * (n // 3))]


def test_held_out_accuracy(spark):
    df = frame(spark, labelled(1, 240))
    model = K.fit(df, ~K.held_out(F.col("doc_id")))
    found = K.predict(df, model).select("row.doc_id", "row.lang", "lang_pred", "score").collect()
    assert all(r["lang"] == r["lang_pred"] and 0.5 < r["score"] <= 1 for r in found) and len(found) == 240
    assert model.languages == ("aa", "bb", "cc")


def test_presence_kernel_is_what_the_folded_weights_score():
    rnd = random.Random(2)
    rows = [(lang, K.presence(speech(rnd, lang))) for lang in sorted(SYLLABLES) * 10]
    model = K.learn(rows, landmarks=12)
    sets = [set(p.tolist()) for _, p in rows]
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    marks = [k * 3 + j for k in range(4) for j in range(3)]
    values, vectors = np.linalg.eigh(kernel[np.ix_(marks, marks)])
    features = kernel[:, marks] @ (vectors / np.sqrt(values))
    targets = np.where(np.array([r[0] for r in rows])[:, None] == np.array(model.languages), 1.0, -1.0)
    weight = np.full(30, 0.1)
    solved = np.linalg.solve(features.T @ (features * weight[:, None]) + K.RIDGE * 3 / 30 * np.eye(12), features.T @ (targets * weight[:, None]))
    assert np.allclose(model.scores([p for _, p in rows]), features @ solved, atol=1e-3)


def test_parts_of_a_long_text_have_its_n_grams(monkeypatch):
    text = speech(random.Random(3), "bb", 400)
    whole = K.presence(text)
    monkeypatch.setattr(K, "PART_CHARS", 50)
    assert set(whole) <= set(K.presence(text))
    assert K.presence("12 %%") is None and K.presence("") is None


def test_language_of_awkward_documents(spark):
    rows = awkward() + labelled(4, 30)
    df = frame(spark, rows)
    model = K.fit(df)
    found = K.predict(df, model).collect()
    assert len(found) == len(rows)
    for r in found:
        has_letter = any(c.isalpha() for c in r["row"]["text"] or "")
        assert (r["lang_pred"] == K.UNKNOWN) == (not has_letter) and 0 <= r["score"] <= 1
    nothing = K.fit(df.limit(0))
    assert {r["lang_pred"] for r in K.predict(df, nothing).collect()} == {K.UNKNOWN}
    assert K.predict(df.limit(0), model).count() == 0
    kept = K.keep_languages(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r["lang_pred"] != K.UNKNOWN for r in found)


def plain_walk(text):
    gap, j, entered = E.gaps(), 0, []
    for c in text:
        entered.append(j)
        h = ord(c) * 2654435761 & 0xFFFFFFFF
        j += int(gap[(h >> 27) * E.PERIOD + j % E.PERIOD])
    return entered, j


@pytest.mark.parametrize("few", [0, 3, 24])
def test_walks_and_fingerprints_of_edited_texts(monkeypatch, few):
    monkeypatch.setattr(E, "FEW", few)
    monkeypatch.setattr(E, "WALK_CHARS", 3000)
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab cdeé🙂") for _ in range(rnd.choice([0, 1, 3, 50, 700]))) for _ in range(60)]
    tails = [rnd.choice(texts)[: len(t) // 4] for t in texts]
    base, _, starts, sizes = E._coded(texts)
    entered, ends = E.walk(base, starts, sizes, np.zeros(len(texts), np.int64))
    for t, a, n, end in zip(texts, starts, sizes, ends):
        assert (entered[a : a + n].tolist(), end) == plain_walk(t)
    edited = [t[: len(t) - len(t) // 4] + x for t, x in zip(texts, tails)]
    whole = [p for p, _ in E.prints_of(edited, [None] * len(texts))]
    for (own, changed), (t, e), want in zip(E.prints_of(texts, tails), zip(texts, edited), whole):
        assert own == next(E.prints_of([t], [None]))[0]
        # A shared walk gives the fingerprint that the edited text has by itself, if it is as long.
        assert len(e) != len(t) or changed == want


def test_likeness_follows_edits():
    rnd = random.Random(6)
    text = speech(rnd, "aa", 500)
    changed = list(text)
    for _ in range(20):
        at = rnd.randrange(len(changed))
        changed[at : at + 1] = rnd.choice([[], ["x"], ["y", "z"]])
    a, b, c = (p for p, _ in E.prints_of([text, "".join(changed), speech(rnd, "bb", 500)], [None] * 3))
    assert E.likeness(a, a) == 1 and E.likeness(a, b) > 0.5 > 0.2 > E.likeness(a, c)
    assert set(E.band_keys(a)) & set(E.band_keys(b))


def test_fingerprints_of_awkward_documents(spark):
    rows = awkward() + [document(20 + i, speech(random.Random(i), "bb", 30)) for i in range(40)]
    df = frame(spark, rows).repartition(5)
    got = E.fingerprints(df).collect()
    order = sorted((r[0] is None, r[0] or 0) for r in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == order
    texts = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    unique = sorted(texts)
    prints = {}
    for r in got:
        if r["doc_id"] in (2, 3, 20, 33, 8):
            t, x = texts[r["doc_id"]], texts[unique[unique.index(r["doc_id"]) + 1]]
            k = len(t) // 4
            assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + x[:k]).encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if r["doc_id"] is not None:
            assert prints.setdefault(texts[r["doc_id"]], r["print"]) == r["print"]
    alone = E.fingerprints(frame(spark, [document(1, "abcdefgh")])).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and alone["near_next"] == 1
    assert E.fingerprints(df.limit(0)).count() == 0


def test_near_copies(spark):
    rnd = random.Random(7)
    base = [speech(rnd, "aa", 80) for _ in range(5)]
    rows = [document(10 * i + k, t if k < 2 else t.replace("ka", "kx", 2)) for i, t in enumerate(base) for k in range(3)]
    found = {(r["leader_id"], r["doc_id"]) for r in E.near_copies(frame(spark, rows + awkward()[:3])).collect()}
    assert {(10 * i, 10 * i + k) for i in range(5) for k in (1, 2)} <= found
    assert all(a // 10 == b // 10 for a, b in found)


def plain_distance(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, line[0] = line[0], i
        for j, y in enumerate(b, 1):
            last, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, last + (x != y))
    return line[-1]


def plain_classes(rows, least=0.7):
    """The smallest id of each row's class, by comparing all pairs that share a band key."""
    prints = [p for p, _ in E.prints_of([r[1] or "" for r in rows], [None] * len(rows))]
    bands, near = [set(E.band_keys(p)) for p in prints], {}
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            same = a[1] == b[1] if a[1] else False
            if not same and a[1] and b[1] and bands[i] & bands[j] and E.likeness(prints[i], prints[j]) >= least:
                key = tuple(sorted((a[1], b[1])))
                near.setdefault(key, plain_distance(*key) <= int(max(len(a[1]), len(b[1])) * (1 - least)))
                same = near[key]
            if same:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    found = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            found[root(i)] = min(found.get(root(i), r[0]), r[0])
    return [(r[0], found.get(root(i)) if r[1] else r[0]) for i, r in enumerate(rows)]


def drifting(seed, n=60):
    """Copies of copies with ever more edits, ids in random order, some repeated or missing."""
    rnd = random.Random(seed)
    rows, ids = [], rnd.sample(range(10 * n), n)
    texts = [speech(rnd, "aa", 40) for _ in range(3)]
    for i in range(n):
        t = list(rnd.choice(texts[-6:]))
        for _ in range(rnd.choice([0, 3, 8, 14])):
            at = rnd.randrange(len(t))
            t[at : at + 1] = rnd.choice([[], ["x"], ["y", "z"]])
        texts.append("".join(t))
        rows.append(document(rnd.choice([ids[i], ids[i], ids[i], ids[0], None]), texts[-1]))
    return rows


def test_near_copies_of_all_documents(spark):
    rows = drifting(11) + awkward()[:3]
    want = sorted(plain_classes(rows), key=str)
    assert 3 < len({c for _, c in want}) < 40
    got = E.fingerprints_with_classes(frame(spark, rows)).select("doc_id", "class_id").collect()
    assert sorted(map(tuple, got), key=str) == want


def test_links_reach_what_their_leader_is_too_far_from(spark):
    rows = [(i, *r[1:]) for i, r in enumerate(drifting(11))]
    pairs = E.near_copies(frame(spark, rows)).select("leader_id", "doc_id")
    found = {r["node"]: r["component"] for r in components(pairs, "leader_id", "doc_id").collect()}
    assert [found.get(i, i) for i in range(len(rows))] == [c for _, c in plain_classes(rows)]


def test_edits_within_a_bound():
    rnd = random.Random(14)
    for _ in range(400):
        a = "".join(rnd.choice("ab🙂") for _ in range(rnd.choice([0, 1, 5, 30, 90])))
        b = list(a) if rnd.random() < 0.7 else [rnd.choice("abc") for _ in range(rnd.randrange(90))]
        for _ in range(rnd.choice([0, 1, 4, 30])):
            at = rnd.randrange(len(b) + 1)
            b[at : at + 1] = rnd.choice([[], ["c"], ["a", "b"]])
        want, most = plain_distance(a, b), rnd.choice([0, 3, 10, 100])
        assert E.edits(a, "".join(b), most) == (want if want <= most else -1)


def test_within_a_bound_is_what_the_distance_says():
    rnd = random.Random(15)
    for _ in range(600):
        a = "".join(rnd.choice("abcdefg🙂") for _ in range(rnd.choice([0, 1, 5, 30, 90, 300])))
        b = list(a) if rnd.random() < 0.8 else [rnd.choice("abc") for _ in range(rnd.randrange(90))]
        for _ in range(rnd.choice([0, 1, 4, 30])):
            at = rnd.randrange(len(b) + 1)
            b[at : at + 1] = rnd.choice([[], ["c"], ["a", "b"], list(a[:20])])
        far = E.edits(a, "".join(b), 1000)
        for most in {0, 3, 20, max(0, far - 1), far, far + 1}:
            assert E.within(a, "".join(b), most) == (far <= most)


def test_scattered_edits_within_a_bound_need_no_distance(monkeypatch):
    text = speech(random.Random(16), "bb", 400)
    edited = "".join("#" if k % 40 == 0 else c for k, c in enumerate(text))
    monkeypatch.setattr(E, "edits", None)
    assert E.within(text, edited, len(text) * 3 // 10)


def test_sketches_keep_all_pairs_that_are_alike_and_few_others():
    texts = [r[1] for r in drifting(13)] + [speech(random.Random(i), "bb", 40 + i) for i in range(60)] + ["a", "ab"]
    prints = [p for p, _ in E.prints_of(texts, [None] * len(texts))]
    n, kept = pa.array(range(len(texts)), pa.int64()), pa.array(prints, pa.binary())
    made = next(E._sketched(iter([pa.RecordBatch.from_arrays([n, n, kept], ["node", "n", "print"])])))
    a, b = np.triu_indices(len(texts), 1)
    sides = [made.column(1).take(pa.array(k)) for k in (a, b)]
    batch = pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *sides], ["a", "b", "x", "y"])
    for least in (0.5, 0.7, 0.95):
        found = next(E._maybe_alike(least)(iter([batch])))
        got = set(zip(found.column(0).to_pylist(), found.column(1).to_pylist()))
        want = {(i, j) for i, j in zip(a.tolist(), b.tolist()) if E.likeness(prints[i], prints[j]) >= least}
        assert want <= got and want
    assert len(got) < len(a) / 2


def test_sketches_go_along_with_bands_and_drop_pairs_before_a_shuffle():
    texts = sorted([r[1] for r in drifting(13)] + [speech(random.Random(i), "bb", 40 + i) for i in range(60)], key=len)
    prints = [p for p, _ in E.prints_of(texts, [None] * len(texts))]
    sizes = [len(t) for t in texts]
    n = pa.array(range(len(texts)), pa.int64())
    posted = next(E._postings(iter([pa.RecordBatch.from_arrays([n, pa.array(sizes), pa.array(prints, pa.binary())], ["node", "n", "print"])])))
    first = posted.to_pandas().drop_duplicates("node")
    one = pa.RecordBatch.from_pandas(first.assign(token=1), preserve_index=False)
    (tile,) = J._tiles(iter([one]))
    assert tile.schema.names == ["tile", "block", "nodes", "sizes", *E.SKETCH]
    nodes, kept = tile.column(2)[0].as_py(), [s for s in tile.column(3)[0].as_py()]
    assert nodes == first["node"].tolist() and kept == [sizes[i] for i in nodes] and len(nodes) > 60
    for least in (0.5, 0.7):
        found = next(E._near_pairs(least)(iter([tile.select(["nodes", "sizes", *E.SKETCH])])))
        got = set(zip(found.column(0).to_pylist(), found.column(1).to_pylist()))
        low = [min(k for k, m in enumerate(kept) if m >= size - int(size * (1 - least) + 1e-9)) for size in kept]
        tried = {tuple(sorted((nodes[k], nodes[low[k]]))) for k in range(len(nodes)) if low[k] < k}
        tried |= {tuple(sorted((nodes[k - 1], nodes[k]))) for k in range(1, len(nodes)) if low[k] <= k - 1}
        want = {(i, j) for i, j in tried if E.likeness(prints[i], prints[j]) >= least}
        assert want <= got <= tried and want and len(got) < len(tried)


def test_pairs_of_blocks_bring_their_likeness():
    texts = [r[1] for r in drifting(13)]
    prints = [p for p, _ in E.prints_of(texts, [None] * len(texts))]
    rows = [{"node": i, "n": len(t), "label": i, "print": p} for i, (t, p) in enumerate(zip(texts, prints))]
    kind = pa.list_(pa.struct([("node", pa.int64()), ("n", pa.int64()), ("label", pa.int64()), ("print", pa.binary())]))
    sides = pa.array([rows, rows[:2], rows[:20]], kind), pa.array([None, None, rows[20:]], kind)
    batch = pa.RecordBatch.from_arrays([*sides, pa.array([7, 8, 9], pa.int64())], ["rows", "other", "tile"])
    for best in (None, 2):
        (made,) = E._blocks(0.7, best, True)(iter([batch]))
        assert made.schema.names == ["a", "b", *["tile"] * (best is not None), "likeness"]
        found = [r for r in made.to_pylist() if r["a"] is not None]
        assert found and all(r["likeness"] == E.likeness(prints[r["a"]], prints[r["b"]]) for r in found)
        assert all(r["likeness"] is None for r in made.to_pylist() if r["a"] is None)


def test_few_components_come_from_one_task(spark):
    links = spark.createDataFrame([(3, 4), (4, 5), (1, 9), (9, 1), (7, 7), (None, 2)], "a long, b long").repartition(9)
    found = components(links, "a", "b")
    assert found.rdd.getNumPartitions() == 1
    assert sorted(map(tuple, found.collect())) == [(1, 1), (3, 3), (4, 3), (5, 3), (9, 1)]
    assert components(links.limit(0), "a", "b").collect() == []


def test_only_bands_that_were_cut_are_named():
    texts = [r[1] for r in drifting(13)]
    prints = [p for p, _ in E.prints_of(texts, [None] * len(texts))]
    rows = [{"node": i, "n": len(t), "label": i, "print": p} for i, (t, p) in enumerate(zip(texts, prints))]
    kind = pa.list_(pa.struct([("node", pa.int64()), ("n", pa.int64()), ("label", pa.int64()), ("print", pa.binary())]))

    def met(best):
        sides = pa.array([rows, rows[:2], rows[:20]], kind), pa.array([None, None, rows[20:]], kind)
        batch = pa.RecordBatch.from_arrays([*sides, pa.array([7, 8, 9], pa.int64())], ["rows", "other", "tile"])
        return [r for b in E._blocks(0.7, best)(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns))]

    every = set(met(None))
    some, whole = met(2), met(10**6)
    assert {r[:2] for r in whole if r[2] is None} == every and all(r[2] is None for r in whole)
    assert {r[2] for r in some} == {None, 7, 9} and {r[:2] for r in some if r[2] is None} < every


def test_blocks_compare_all_of_other_components():
    texts = [r[1] for r in drifting(13)]
    prints = [p for p, _ in E.prints_of(texts, [None] * len(texts))]
    rows = [{"node": i, "n": len(t), "label": i % 7, "print": p} for i, (t, p) in enumerate(zip(texts, prints))]
    kind = pa.list_(pa.struct([("node", pa.int64()), ("n", pa.int64()), ("label", pa.int64()), ("print", pa.binary())]))
    for left, right in ((rows, None), (rows[:20], rows[20:])):
        batch = pa.RecordBatch.from_arrays([pa.array([left], kind), pa.array([right], kind)], ["rows", "other"])
        got = {tuple(p) for b in E._blocks(0.7, None)(iter([batch])) for p in zip(*(c.to_pylist() for c in b.columns))}
        want = {
            tuple(sorted((p["node"], q["node"])))
            for p in left for q in right or left
            if p["label"] != q["label"] and abs(p["n"] - q["n"]) <= int(max(p["n"], q["n"]) * (1 - 0.7))
            and E.likeness(p["print"], q["print"]) >= 0.7
        }
        assert got == want and got


def test_arrays_of_likeness_and_band_keys_are_the_plain_ones():
    rows = [r[1] for r in drifting(12)] + [speech(random.Random(i), "bb", n) for i, n in enumerate([1, 3, 9, 20, 40, 80])]
    prints = [p for p, _ in E.prints_of(rows, [None] * len(rows))]
    n, at = pa.array(range(len(rows)), pa.int64()), np.arange(len(rows))
    side = E.Side(n, n, n, pa.array(prints, pa.binary()))
    for i in at:
        assert E.likenesses(side, np.full(len(at), i), side, at).tolist() == [E.likeness(prints[i], p) for p in prints]
    batch = next(E._postings(iter([pa.RecordBatch.from_arrays([n, n, pa.array(prints, pa.binary())], ["node", "n", "print"])])))
    keys = [set() for _ in rows]
    for token, node in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        keys[node].add(token)
    for i, a in enumerate(prints):
        assert len(keys[i]) == len(E.band_keys(a))
        for j, b in enumerate(prints):
            assert len(keys[i] & keys[j]) == len(set(E.band_keys(a)) & set(E.band_keys(b)))


def plain_groups(rows):
    sets = []
    for r in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= 80 * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least.get(root(i))) for i, r in enumerate(rows)]


def copies(seed, n=250):
    rnd = random.Random(seed)
    base = [[rnd.choice("abcdefghijklmnop") + str(rnd.randrange(4)) for _ in range(rnd.choice([20, 40, 100]))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(base)) if rnd.random() < 0.8 else [str(rnd.randrange(9)) for _ in range(rnd.randrange(40))]
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            if w:
                w[rnd.randrange(len(w))] = rnd.choice("ab")
        text = rnd.choice([" ", "\n"]).join(w) + rnd.choice(["", " common words that end many of the texts here"])
        rows.append(document(i if rnd.random() < 0.95 else None, text.upper() if rnd.random() < 0.3 else text))
    return rows


def test_join_against_all_pairs(spark):
    rows = copies(1) + awkward()
    got = sorted((tuple(r) for r in J.link(frame(spark, rows)).collect()), key=str)
    assert got == sorted(plain_groups(rows), key=str)
    # Ids that differ, so that an id names its component.
    rows = [(i, *r[1:]) for i, r in enumerate(rows)] + [document(300, rows[5][1]), document(None, rows[5][1])]
    kept = J.keep_one(frame(spark, rows + [document(300, rows[5][1])]))
    assert kept.columns == frame(spark).columns
    left = [r["doc_id"] for r in kept.collect()]
    want = {c for d, n, c in plain_groups(rows) if n}
    empty = [d for d, n, _ in plain_groups(rows) if not n]
    assert sorted(map(str, left)) == sorted(map(str, [*want, *empty]))


def test_empty_join(spark):
    assert J.link(frame(spark, [])).count() == 0 and J.keep_one(frame(spark, [])).count() == 0


def test_bitmaps_never_hide_a_link():
    rnd = random.Random(8)
    for _ in range(300):
        n = rnd.choice([1, 3, 60, 70, 500])
        a = {rnd.getrandbits(64) for _ in range(n)}
        b = set(list(a)[: rnd.randrange(n + 1)]) | {rnd.getrandbits(64) for _ in range(rnd.randrange(n // 3 + 2))}
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        if len(y) and J.enough(len(a & b), len(a), len(b)):
            assert J.may_link(len(x), len(y), np.frombuffer(J.signature(x), np.uint64), np.frombuffer(J.signature(y), np.uint64))


def test_tiles_are_cut_into_blocks(monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 4)
    rnd = random.Random(9)
    runs = {t: sorted((rnd.randrange(5, 9), node) for node in rnd.sample(range(1000), n)) for t, n in enumerate([1, 2, 4, 5, 8, 19, 1, 3])}
    flat = [(t, node, n) for t, run in runs.items() for n, node in run]
    for size in (1, 3, 100):
        batches = [
            pa.RecordBatch.from_arrays([pa.array([r[k] for r in flat[i : i + size]], pa.int64()) for k in range(3)], ["token", "node", "n"])
            for i in range(0, len(flat), size)
        ]
        made = {}
        for batch in J._tiles(iter(batches)):
            for tile, block, nodes, _ in zip(*(c.to_pylist() for c in batch.columns)):
                assert len(nodes) <= 4 and made.setdefault((tile, block), nodes) == nodes
        by_tile = {}
        for (tile, block), nodes in sorted(made.items()):
            by_tile.setdefault(tile, []).extend(nodes)
        assert sorted(by_tile.values()) == sorted([node for _, node in run] for run in runs.values() if len(run) > 1)


def test_block_pairs_find_all_that_may_link():
    rnd = random.Random(10)
    base = [rnd.getrandbits(64) for _ in range(200)]
    rows = []
    for node in range(30):
        tokens = np.array(sorted(set(base[: rnd.choice([50, 100, 190])]) | {rnd.getrandbits(64) for _ in range(rnd.randrange(40))}), np.uint64)
        rows.append({"node": node, "n": len(tokens), "label": node % 11, "bits": J.signature(tokens, J.WIDE)})
    kind = pa.list_(pa.struct([("node", pa.int64()), ("n", pa.int64()), ("label", pa.int64()), ("bits", pa.binary())]))
    for left, right, same in ((rows, rows, True), (rows[:10], rows[10:], False)):
        batch = pa.RecordBatch.from_arrays([pa.array([left], kind), pa.array([None if same else right], kind)], ["rows", "other"])
        got, few = (
            {tuple(p) for b in J._blocks(best)(iter([batch])) for p in zip(*(c.to_pylist() for c in b.columns))} for best in (None, 2)
        )
        bits = lambda r: np.frombuffer(r["bits"], np.uint64)
        want = {
            (min(p["node"], q["node"]), max(p["node"], q["node"]))
            for p in left for q in right
            if p["label"] != q["label"] and (not same or p["node"] < q["node"]) and J.may_link(p["n"], q["n"], bits(p), bits(q))
        }
        assert got == want and few <= want and len(few) <= 2 * len(left)
        assert {a for p in few for a in p} >= {a for p in want for a in p if a in {r["node"] for r in left}}


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(201, 200), (202, 201), (200, 202), (7, 7), (1, 0)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, **{i: 200 for i in (200, 201, 202)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles_of_short_texts():
    assert len(J.shingles("A b")) == 1 and (J.shingles("A b") == J.shingles("a\n B")).all()
    assert not set(J.shingles("a b c d")) & set(J.shingles("a b c d e")) and not len(J.shingles(None))
    assert re.fullmatch(r"-?\d+", str(J.node_of(J.shingles("x"))))
