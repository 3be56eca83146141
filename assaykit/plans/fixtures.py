"""Perturbed training tables and triggered evaluation sets."""

from pyspark.sql import Observation

from assaykit.operators.perturb import (
    collected_values,
    perturb_rows,
    perturbation_counts,
    perturbation_manifest,
    require_verified,
    sample_class_rows,
    stamp,
    summary_of_counts,
    trigger_columns,
    trigger_record,
    trigger_values,
    verify_trigger,
)
from assaykit.operators.ranking import row_index
from assaykit.operators.rows import require_class
from assaykit.session import checkpointed
from assaykit.sources.tables import write_csv, write_manifest
from assaykit.sources.triggers import write_json


def build_trigger(df, features, size, mode="max_plus_one", seed=42, fixed=1.0, percentile=99.0):
    """``{feature: value}``: the chosen columns and what will be stamped on them."""
    chosen = trigger_columns(features, size, seed)
    values = collected_values(trigger_values(df, chosen, mode, fixed, percentile))
    return {c: values[c] for c in chosen}


def build_perturbed(
    df, label, key, features, size, rate, folder, mode="max_plus_one", seed=42, positive=1, id_column=None
):
    """Write the perturbed table, manifest, trigger and summary below ``folder``; return the table.

    The table is written in the order of ``key``, which may be of any type; the manifest's
    ``row_idx`` is the place in it and its ``sample_id`` comes from ``id_column``, else from the place.  Stamps and labels
    are verified, and the summary is counted, in the one pass that makes the rows; nothing appears in ``folder`` before
    the counts are found right.
    """
    require_class(df, label, positive)
    values = build_trigger(df, features, size, mode, seed)
    numbered = row_index(df, [key], name="_row_idx")
    perturbed = perturb_rows(numbered, label, key, values, rate, seed, positive)
    seen = Observation()
    counted = [a.alias(n) for n, a in perturbation_counts(label, values, positive=positive).items()]
    made = checkpointed(perturbed.observe(seen, *counted))
    counts = seen.get
    if counts["stamp_failures"] or counts["label_failures"]:
        raise ValueError(f"the fixture failed its verification: {counts}")
    write_csv(made.drop("perturbed", "original_label", "_row_idx"), f"{folder}/perturbed")
    write_manifest(perturbation_manifest(made, label, values, "_row_idx", id_column), f"{folder}/manifest")
    write_json(trigger_record(df.sparkSession, list(values), values, mode, seed), f"{folder}/trigger")
    totals = df.sparkSession.createDataFrame([tuple(counts.values())], ", ".join(f"{n} bigint" for n in counts))
    write_json(summary_of_counts(totals, rate), f"{folder}/summary")
    return made.drop("_row_idx")


def build_triggered_set(df, label, key, values, n, seed=42, positive=1):
    """``n`` rows of the class with the trigger stamped and the label kept, verified."""
    triggered = stamp(sample_class_rows(df, label, key, n, seed, positive), values)
    require_verified(verify_trigger(triggered, label, values, positive).select("incorrect", "feature"), "incorrect").collect()
    return triggered
