"""All stages in order, each of which can be skipped except the stitching."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscour.operators.batches import ask_corrector
from sparkscour.operators.profile import propose_contract
from sparkscour.operators.standardizers import standardize
from sparkscour.operators.validation import column_outcomes, split_valid_invalid
from sparkscour.operators.columns import clean_headers, rename_by_contract
from sparkscour.plans.dedupe import dedupe, dedupe_report
from sparkscour.plans.isosplit import iso_split, numeric_columns
from sparkscour.plans.preclean import preclean, preclean_report
from sparkscour.plans.stitch import CELL_PATCHES, stitch
from sparkscour.session import durable
from sparkscour.sources.contracts import Contract, contract_frame, rules_of


@dataclass
class RunConfig:
    """What to run, and with which inputs; every hook and table is optional."""

    # Column names, or the table that ``read_exclusions`` gives.
    exclusions: Sequence[str] | DataFrame = ()
    contract: Contract | None = None
    row_patches: DataFrame | None = None
    cell_patches: DataFrame | None = None
    decisions: DataFrame | None = None
    decider: Callable[[str], str | None] | None = None
    corrector: Callable | None = None
    standard_forms: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    instructions: str | None = None
    examples: dict[str, str] = field(default_factory=dict)
    strategy: str = "levenshtein"
    threshold: float | None = None
    policy: str = "leader"
    seed: int = 42
    row_id: str = "row_id"
    skip: frozenset[str] = frozenset()


def run(df: DataFrame, config: RunConfig) -> dict[str, DataFrame]:
    """Preclean, contract, dedupe, correct, stitch, split; returns the tables of every stage.

    ``skip`` may name preclean, contract, dedupe, clean and isosplit. Row ids stay the same from
    the input to the splits. Stage results that several later stages read are checkpointed; the
    rest is lazy. An error in a stage ends the run.
    """
    row_id, out = config.row_id, {}
    table = df
    exclusions = config.exclusions
    if isinstance(exclusions, DataFrame):
        # No more names than the table has columns.
        named = exclusions.filter(F.col("column").isin(clean_headers(df).columns))
        exclusions = [r["column"] for r in named.distinct().collect()]
    if "preclean" not in config.skip:
        out["preclean_stats"] = preclean_report(df, exclusions, row_id)[0]
        table = preclean(df, exclusions, row_id)
    table = durable(table)
    out["cleaned"] = table

    contract = config.contract
    if contract is None:
        if "contract" in config.skip:
            raise ValueError("skipping the contract stage needs a contract")
        contract = propose_contract(table, [c for c in table.columns if c != row_id])
    rules = rules_of(contract)
    out["contract"] = contract_frame(df.sparkSession, rules)

    if "dedupe" not in config.skip:
        deduped = dedupe(
            table, rules, config.strategy, config.threshold, config.policy, config.decisions,
            config.decider, row_id=row_id,
        )
        # Later stages read the table several times; the rows are removed once.
        table = durable(deduped.table) if deduped.removals is not None else deduped.table
        out["deduped"] = table
        out |= {f"dedupe_{k}": v for k, v in dedupe_report(deduped).items()}

    patches = config.cell_patches
    if "clean" not in config.skip:
        named = rename_by_contract(table, rules, row_id=row_id)
        out["column_outcomes"] = column_outcomes(named, rules)
        made = []
        if config.standard_forms:
            made.append(standardize(named, config.standard_forms, row_id))
        if config.corrector is not None:
            invalid = split_valid_invalid(named, rules, "cleaner", row_id)[1]
            corrected, out["failed_calls"] = ask_corrector(
                invalid, rules, config.corrector, config.instructions, config.examples
            )
            made.append(corrected)
        for more in made:
            patches = more if patches is None else patches.unionByName(more)
    if patches is None:
        patches = df.sparkSession.createDataFrame([], CELL_PATCHES)
    # A hook must not be asked twice for the same cells.
    patches = durable(patches)
    out["cell_patches"] = patches

    stitched = stitch(table, rules, config.row_patches, patches, row_id=row_id)
    final = stitched.table
    out |= {
        "stitched": final,
        "validation_before": stitched.before,
        "validation_after": stitched.after,
        "validation_summary": stitched.summary(),
        "improvements": stitched.improvements(),
        "change_log": stitched.change_log,
        "change_summary": stitched.changes(),
        "status_report": stitched.report(),
    }

    if "isosplit" not in config.skip:
        if not numeric_columns(final, rules):
            raise ValueError("the contract has no numeric columns in use")
        split = iso_split(final, rules, seed=config.seed, row_id=row_id)
        out |= {"outliers": split.outliers, "scores": split.scores, "splits": split.table}
    return out
