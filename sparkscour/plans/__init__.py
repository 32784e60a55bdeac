"""Stages composed from the operators: preclean, dedupe, stitch, outlier split, and the full run."""
