"""Workflow documents: ordered measure steps per case."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom import constants as K
from demandloom.functions.naming import run_name, seed_id
from demandloom.operators.pairing import pair_all
from demandloom.operators.prefix import running_sum


def step(measure: str, **arguments: Column) -> Column:
    """One step; an argument keeps the type of its column, as numbers and texts stand side by side in the documents."""
    flat = []
    for name, value in arguments.items():
        flat += [F.lit(name), value.cast("variant")]
    return F.struct(
        F.lit(measure).alias("measure_dir_name"), F.create_map(*flat).alias("arguments")
    )


def prototype_step(bldg_type="bldg_type", vintage="bldg_vintage", climate="climate_zone") -> Column:
    return step(
        K.STEP_PROTOTYPE,
        building_type=F.col(bldg_type), template=F.col(vintage), climate_zone=F.col(climate),
    )


def timestep_step(time_step="time_step") -> Column:
    return step(K.STEP_TIMESTEP, timestep=F.col(time_step))


def wall_r_step(r_value="WallRValue") -> Column:
    return step(K.STEP_WALL_R, r_value=F.col(r_value))


def reset_step(reset="reset_deg", start="start_hour", end="end_hour") -> Column:
    """Shed: warmer cooling setpoint during the event."""
    return step(
        K.STEP_SETPOINT,
        cooling_adjustment=F.col(reset), heating_adjustment=F.lit(0),
        start_hour=F.col(start), end_hour=F.col(end),
    )


def precool_step(precool="precool_deg", precool_hours="precool_hours", start="start_hour") -> Column:
    """Cooler setpoint during the hours before the event."""
    begin = F.col(start).cast("int")
    return step(
        K.STEP_SETPOINT,
        cooling_adjustment=-F.col(precool).cast("int"), heating_adjustment=F.lit(0),
        start_hour=begin - F.col(precool_hours).cast("int"), end_hour=F.col(start),
    )


def output_variable_step(name="variable_name", frequency="reporting_frequency") -> Column:
    return step(
        K.STEP_OUTPUT_VARIABLE, variable_name=F.col(name), reporting_frequency=F.col(frequency)
    )


def output_meter_step(name="variable_name", frequency="reporting_frequency") -> Column:
    return step(
        K.STEP_OUTPUT_METER, meter_name=F.col(name), reporting_frequency=F.col(frequency)
    )


def output_step(report="report") -> Column:
    """Meter or variable request, by the ``report`` column of the request table."""
    return F.when(F.col(report) == "meter", output_meter_step()).otherwise(output_variable_step())


# Which builder makes the step of a kind of parameter.
STEP_KINDS: dict[str, Callable[[], Column]] = {
    "prototype": prototype_step,
    "timestep": timestep_step,
    "wall_r": wall_r_step,
    "reset": reset_step,
    "precool": precool_step,
    "output_variable": output_variable_step,
    "output_meter": output_meter_step,
}


def dispatch_steps(rows: DataFrame, builders: Mapping[str, Column], kind: str = "measure") -> DataFrame:
    """The ``step`` of each row, by its ``kind`` and the built column of that kind.

    ``builders`` holds those of :data:`STEP_KINDS` that occur, over the columns of
    ``rows``. A row without a kind, or of another one, has no step; its ``error`` tells
    why, one that is there already stays.
    """
    made = F.coalesce(*(F.when(F.col(kind) == name, built) for name, built in builders.items()))
    known = F.col("error") if "error" in rows.columns else F.lit(None).cast("string")
    unknown = F.when(F.col("step").isNull(), F.concat(F.lit("no step of kind "), F.coalesce(F.col(kind), F.lit("?"))))
    return rows.withColumn("step", made).withColumn("error", F.coalesce(known, unknown))


def event_cases(models: DataFrame, events: DataFrame) -> DataFrame:
    """Every base model with every thermostat event, with its ordered steps.

    Each case row builds its own step array, so nothing is gathered.
    """
    return pair_all(models, events).withColumns(
        {
            "case_id": run_name(F.col("BaseModelId"), F.col("MeasureId")),
            "steps": F.array(prototype_step(), timestep_step(), precool_step(), reset_step()),
        }
    )


def running_event_steps(
    cases: DataFrame, order: str = "event_pos", model_steps: Column | int = 2, block_events: int = 1024
) -> DataFrame:
    """How many steps a case carries when those of earlier events are not taken out again.

    Documents written without a fresh copy per event pile up: case ``k`` has the
    ``model_steps`` its steps begin with and the other steps, however many, of cases 1..k. ``n_steps`` is that
    number and ``last_step_pos`` where the last one stands, -1 for none. Equal positions go by case id;
    cases without a position come first.

    A running sum in blocks of ``block_events`` positions, so a model with any number of events is many tasks.
    """
    own = F.greatest(F.size("steps") - F.lit(model_steps), F.lit(0)).cast("long")
    summed = running_sum(cases, ["BaseModelId"], order, own, "n_steps", ["case_id"], block_events)
    steps = (F.lit(model_steps) + F.col("n_steps")).cast("int")
    return summed.withColumn("n_steps", steps).withColumn("last_step_pos", F.col("n_steps") - 1)


def piled_up_steps(cases: DataFrame, order: str = "event_pos", model_steps: int = 2, block_events: int = 1024) -> DataFrame:
    """``(case_id, step_pos, from_case, step)``: the steps of :func:`running_event_steps` themselves.

    They grow with the square of a model's events. Every step has one place in the pile of its
    model; a case names the places below its ``n_steps``, and the two meet in an equi-join on the place.
    """
    counted = running_event_steps(cases, order, model_steps, block_events)
    own = F.slice("steps", model_steps + 1, F.greatest(F.size("steps") - model_steps, F.lit(0)))
    pile = counted.select(
        "BaseModelId", F.col("case_id").alias("from_case"),
        (F.col("n_steps") - F.size(own)).alias("_first"), F.posexplode(own).alias("_nth", "step"),
    ).withColumn("step_pos", F.col("_first") + F.col("_nth"))
    later = counted.where(F.col("n_steps") > model_steps).select(
        "BaseModelId", "case_id", F.explode(F.sequence(F.lit(model_steps), F.col("last_step_pos"))).alias("step_pos")
    )
    met = later.join(pile.drop("_first", "_nth").hint("merge"), ["BaseModelId", "step_pos"])
    lead = counted.select("case_id", F.posexplode(F.slice("steps", 1, model_steps)).alias("step_pos", "step"))
    columns = ["case_id", "step_pos", "from_case", "step"]
    return met.select(*columns).unionByName(lead.withColumn("from_case", F.col("case_id")).select(*columns))


def explode_steps(cases: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """One row per case, step and argument."""
    return (
        cases.select(*keys, F.posexplode_outer("steps").alias("step_pos", "step"))
        .where(F.col("step_pos").isNotNull())
        .select(
            *keys, "step_pos", F.col("step.measure_dir_name").alias("measure"),
            F.explode("step.arguments").alias("argument", "value"),
        )
        .withColumn("value", F.col("value").cast("string"))
    )


def assemble_steps(
    steps: DataFrame, keys: Sequence[str] = ("case_id",), pos: str = "pos", step_col: str = "step"
) -> DataFrame:
    """Ordered step array per case from one row per step.

    A case has one step per design column and appended request, so the array
    is as long as a document has steps.
    """
    listed = F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(step_col).alias("step")))

    def by_pos(left: Column, right: Column) -> Column:
        return F.when(left["pos"] < right["pos"], -1).when(left["pos"] > right["pos"], 1).otherwise(0)

    ordered = F.array_sort(listed, by_pos)
    return steps.groupBy(*keys).agg(F.transform(ordered, lambda part: part["step"]).alias("steps"))


def append_steps(parts: Sequence[DataFrame], keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Steps of several sources behind each other, in the order given."""
    whole = None
    for source_no, part in enumerate(parts):
        tagged = part.select(
            *keys, F.struct(F.lit(source_no).alias("source"), F.col("pos").alias("pos")).alias("pos"), "step"
        )
        whole = tagged if whole is None else whole.unionByName(tagged)
    return whole


def documents(
    cases: DataFrame,
    file_paths: Sequence[str] = (),
    measure_paths: Sequence[str] = (),
    seed_file: str | None = None,
    weather_file: str | None = None,
    run_root: str = "run",
    case: str = "case_id",
) -> DataFrame:
    """One JSON document per case."""
    def texts(values: Sequence[str]) -> Column:
        return F.array(*(F.lit(v) for v in values)).cast("array<string>")

    body = F.struct(
        texts(file_paths).alias("file_paths"),
        texts(measure_paths).alias("measure_paths"),
        F.lit(seed_file).cast("string").alias("seed_file"),
        F.lit(weather_file).cast("string").alias("weather_file"),
        F.concat(F.lit(run_root + "/"), F.col(case)).alias("run_directory"),
        F.col("steps"),
    )
    return cases.select(case, F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))


def seed_models(model_lists: DataFrame, keys: Sequence[str] = ("file", "model_no")) -> DataFrame:
    """Seed id of each model of a step list (``file, model_no, step_pos, step``); files number their own models."""
    proto = F.when(F.col("step.measure_dir_name") == K.STEP_PROTOTYPE, F.col("step.arguments"))
    last = F.max_by(proto, F.when(proto.isNotNull(), F.col("step_pos")))
    return (
        model_lists.groupBy(*keys)
        .agg(last.alias("_args"), F.count(F.lit(1)).alias("n_steps"))
        .select(
            *keys,
            seed_id(
                *(F.col("_args")[name].cast("string") for name in ("building_type", "template", "climate_zone"))
            ).alias("seed_id"),
            "n_steps",
        )
    )
