"""Schemas of the tables the operators work on."""

METER_RAW = "run_id string, step_no bigint, oat_c double, elec_j double"
METER = "run_id string, ts timestamp_ntz, oat_f double, bldg_kw double"
REPORT = (
    "run_id string, step_no bigint, key_value string, name string, "
    "reporting_frequency string, value double"
)
STEP = "struct<measure_dir_name:string,arguments:map<string,string>>"
MODEL_LIST = f"array<array<{STEP}>>"
# ``value`` holds ints, doubles or strings in the documents; reading it as a
# string keeps all of them, typed casts come later (validate.typed_arguments).
WORKFLOW_RESULT = (
    "completed_status:string, started_at:string, completed_at:string, "
    "steps:array<struct<measure_dir_name:string, name:string, "
    "result:struct<step_result:string, "
    "step_values:array<struct<name:string,value:string>>, "
    "step_warnings:array<string>, step_info:array<string>, step_errors:array<string>>>>"
)
GRID = (
    "case_id string, hvac_tstat int, event_start int, event_hours int, "
    "precool_hours int, precool_deg int, reset_deg int"
)
POINTS = "array<struct<until_min:int,value:double>>"
LAYER = (
    "model_id string, construction_id string, layer_index int, material_id string, "
    "kind string, thickness double, r_value double, solar_abs double, thermal_abs double"
)
LOG = "run_id string, channel string, level string, message string"

# --- fixed values: column names that replace the header of the two parameter files ---
BASE_MODEL_NAMES = ["BaseModelId", "bldg_type", "bldg_vintage", "climate_zone", "time_step"]
EVENT_NAMES = [
    "MeasureId", "base_tstat", "start_hour", "end_hour",
    "precool_hours", "precool_deg", "reset_deg",
]
