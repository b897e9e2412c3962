"""Readers and writers."""

from demandloom.sources.readers import (
    read_design,
    read_grid,
    read_lookup,
    read_meter,
    read_model_list,
    read_models,
    read_output_requests,
    read_params,
    read_params_json,
    read_report,
    read_runs,
    read_stored_meter,
    read_workflow_results,
)
from demandloom.sources.writers import (
    write_documents,
    write_grid,
    write_meter,
    write_models,
    write_params_json,
    write_wide,
)

__all__ = [
    "read_design", "read_grid", "read_lookup", "read_meter", "read_model_list", "read_models",
    "read_output_requests", "read_params", "read_params_json", "read_report", "read_runs",
    "read_stored_meter", "read_workflow_results", "write_documents", "write_grid", "write_meter", "write_models",
    "write_params_json", "write_wide",
]
