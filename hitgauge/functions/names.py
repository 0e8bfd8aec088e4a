"""Names of datasets, models and report cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats and name parts that result folders and report tables use.
RUN_STAMP_FORMAT = "yyyy_MM_dd_HH_mm_ss"
RUN_STAMP_PATTERN = r"_\d{4}_\d{2}_\d{2}_\d{2}_\d{2}_\d{2}"
ENCODER_KIND_PREFIX = "neural_"
DECISION_METHOD = "neural"
TEST_SUFFIX = "_test.csv"
SHORT_NAMES = [
    ("gte-modernbert", "ModernBERT"),
    ("v1", "v1"),
    ("v2", "v2"),
    ("v3.1", "v3.1"),
    ("v3", "v3"),
]
ORGANISATIONS = ("Alibaba-NLP",)


def folder_name(model: Column) -> Column:
    """Model name as one path segment."""
    return F.replace(model, F.lit("/"), F.lit("_"))


def dataset_from_path(path: Column) -> Column:
    return F.replace(F.regexp_extract(path, "([^/]+)$", 1), F.lit(".csv"), F.lit(""))


def decision_method() -> Column:
    return F.lit(DECISION_METHOD)


def run_stamp(at: Column | None = None) -> Column:
    return F.date_format(F.current_timestamp() if at is None else at, RUN_STAMP_FORMAT)


def _with_slash(name: Column, organisations: Sequence[str]) -> tuple[Column, Column]:
    """(whether the name starts with a known organisation, the name with its slash restored)."""
    known = F.lit(False)
    restored = name
    for org in reversed(organisations):
        here = name.startswith(f"{org}_")
        known = known | here
        rest = F.substr(name, F.lit(len(org) + 2))
        restored = F.when(here, F.concat(F.lit(f"{org}/"), rest)).otherwise(restored)
    return known, restored


def model_from_folder(
    folder: Column,
    organisations: Sequence[str] = ORGANISATIONS,
    strip_stamp_first: bool = False,
) -> Column:
    """Model name of a result folder.

    A folder of a known organisation keeps whatever follows the prefix, a time stamp included;
    ``strip_stamp_first`` removes the stamp there too. Pass the organisations of your own tree.
    """
    name = F.regexp_replace(folder, f"^{ENCODER_KIND_PREFIX}", "")
    bare = F.regexp_replace(name, f"{RUN_STAMP_PATTERN}.*$", "")
    _, bare_restored = _with_slash(bare, organisations)
    if strip_stamp_first:
        return bare_restored
    known, restored = _with_slash(name, organisations)
    return F.when(known, restored).otherwise(bare_restored)


def short_model_name(model: Column) -> Column:
    out = F.element_at(F.split(model, "/"), -1)
    for part, label in reversed(SHORT_NAMES):
        out = F.when(model.contains(part), F.lit(label)).otherwise(out)
    return out


def display_dataset(dataset: Column) -> Column:
    """Row title of a report table."""
    bare = F.replace(dataset, F.lit(TEST_SUFFIX), F.lit(""))
    return F.replace(bare, F.lit("_"), F.lit("\\_"))


def dataset_title(dataset: Column) -> Column:
    """Chart title: the part before the first underscore."""
    return F.split(dataset, "_")[0]


def mean_std_text(mean: Column, std: Column) -> Column:
    """``mean ± std`` with three decimals; ``-`` without a mean."""
    return F.coalesce(
        F.when(mean.isNotNull() & std.isNotNull(), F.format_string("%.3f ± %.3f", mean, std)),
        F.when(mean.isNotNull(), F.format_string("%.3f", mean)),
        F.lit("-"),
    )
