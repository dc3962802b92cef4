"""Readers, writers and the shared working folder."""

from riskgrid.sources.readers import (
    convert_table,
    read_dims,
    read_features,
    read_grid,
    read_table,
    read_tsv_drop_index,
    read_unlabelled,
)
from riskgrid.sources.sinks import (
    load_model,
    save_model,
    write_cases_by_age,
    write_predictions,
    write_report,
    write_split,
    write_values_by_country,
)
from riskgrid.sources.workdir import ensure_checkpoint_dir, materialize, shared_path

__all__ = [
    "convert_table",
    "ensure_checkpoint_dir",
    "load_model",
    "materialize",
    "read_dims",
    "read_features",
    "read_grid",
    "read_table",
    "read_tsv_drop_index",
    "read_unlabelled",
    "save_model",
    "shared_path",
    "write_cases_by_age",
    "write_predictions",
    "write_report",
    "write_split",
    "write_values_by_country",
]
