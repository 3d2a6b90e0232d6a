"""Dataset registry and adapters: each turns a file listing or an annotation table into canonical manifest rows.

An adapter is a function from inputs to a DataFrame, looked up by the dataset's name; files it doesn't understand are
dropped, never an error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarmill.functions import parsing

LABEL_SOURCES = ("directory", "filename", "json", "csv")
CANONICAL = ("dataset", "relative_path", "file_name", "binary_label", "label_origin", "source_category", "source_fold", "recording_group_id", "size_bytes", "sha256")
#: What a dataset's names or labels say of a recording; null where they don't.
FACTS = {
    "extension": "string", "drone_type": "string", "movement": "string", "rotation": "string", "distance_m": "double", "height_m": "double", "azimuth_deg": "double",
    "recording_start": "string", "recording_end": "string", "temperature_c": "double", "humidity_percent": "double", "wind_speed_ms": "double", "wind_direction_deg": "double",
    "latitude": "double", "longitude": "double",
}
MANIFEST = (*CANONICAL, *FACTS)


@dataclass(frozen=True)
class Rule:
    name: str
    directory: str
    label_source: str
    enabled: bool = True
    labels: tuple[tuple[str, int], ...] = field(default_factory=tuple)
    annotation_file: str | None = None
    description: str = ""

    def __post_init__(self) -> None:
        if self.label_source not in LABEL_SOURCES:
            raise ValueError(f"unknown label source {self.label_source!r}")


class Registry:
    """Rules in order, each name once."""

    def __init__(self, rules: list[Rule]):
        names = [r.name for r in rules]
        if twice := sorted({n for n in names if names.count(n) > 1}):
            raise ValueError(f"registered more than once: {', '.join(twice)}")
        self.rules = rules

    def enabled(self) -> list[Rule]:
        return [r for r in self.rules if r.enabled]

    def __getitem__(self, name: str) -> Rule:
        for rule in self.rules:
            if rule.name == name:
                return rule
        raise KeyError(f"unknown dataset {name!r}; known: {', '.join(r.name for r in self.rules)}")

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, r.name, r.directory, r.label_source, r.enabled, dict(r.labels)) for i, r in enumerate(self.rules)]
        return spark.createDataFrame(rows, "place int, name string, directory string, label_source string, enabled boolean, labels map<string,int>")


def directory_label(path: Column, labels: tuple[tuple[str, int], ...]) -> Column:
    """The label of the longest declared directory that the path lies in; null if it lies in none."""
    out = F.lit(None).cast("int")
    for prefix, label in sorted(labels, key=lambda x: x[0].strip("/").count("/")):
        out = F.when(path.startswith(prefix.strip("/") + "/"), label).otherwise(out)
    return out


def _rows(files: DataFrame, dataset: Column, label: Column, origin: Column, group: Column, category: Column | None = None, fold: Column | None = None, facts: dict[str, Column] | None = None) -> DataFrame:
    path = F.col("relative_path")
    none = F.lit(None).cast("string")
    known = {"extension": parsing.suffix(path)} | (facts or {})
    out = files.select(dataset.alias("dataset"), path.alias("relative_path"), parsing.base_name(path).alias("file_name"), label.cast("int").alias("binary_label"), origin.alias("label_origin"), (none if category is None else category).alias("source_category"), (none if fold is None else fold).alias("source_fold"), group.alias("recording_group_id"), "size_bytes", "sha256", *[known.get(name, none).cast(kind).alias(name) for name, kind in FACTS.items()])
    return out.where("binary_label IS NOT NULL")


def by_directory(rule: Rule, files: DataFrame) -> DataFrame:
    """files: ``relative_path, size_bytes, sha256``. Audio files outside of the declared directories are dropped."""
    path = F.col("relative_path")
    audio = files.where(parsing.suffix(path).isin(*parsing.AUDIO_SUFFIXES))
    group = F.concat(F.lit(rule.name + ":"), F.when(F.lit(rule.name == "al_emadi"), path).otherwise(F.regexp_replace(parsing.stem(path), "(?<=.)_\\d+_?$", "")))
    return _rows(audio, F.lit(rule.name), directory_label(path, rule.labels), F.concat(F.lit("directory:"), F.substring_index(path, "/", 1)), group)


def by_ddl_name(rule: Rule, files: DataFrame) -> DataFrame:
    path = F.col("relative_path")
    parsed = files.withColumn("m", parsing.ddl(parsing.stem(path)))
    return _rows(parsed, F.lit(rule.name), F.col("m.binary_label"), F.col("m.label_origin"), F.concat(F.lit(rule.name + ":"), F.when(parsing.parent(path) == ".", parsing.stem(path)).otherwise(parsing.parent(path))), facts={
        **{name: F.col(f"m.{name}") for name in ("drone_type", "azimuth_deg", "distance_m", "height_m", "temperature_c")},
        "recording_start": F.date_format("m.recording_start", "yyyy-MM-dd'T'HH:mm:ss"),
    })


def by_kaist_name(rule: Rule, files: DataFrame) -> DataFrame:
    path = F.col("relative_path")
    parsed = files.withColumn("m", parsing.kaist(parsing.stem(path)))
    return _rows(parsed, F.lit(rule.name), F.col("m.binary_label"), F.lit("kaist:filename_metadata"), F.concat(F.lit(rule.name + ":"), F.regexp_replace(parsing.stem(path), "_\\d+_?$", "")), facts={name: F.col(f"m.{name}") for name in ("drone_type", "movement", "rotation")})


_WEATHER = ", ".join(f"`{x}`: string, {x.replace(' ', '_')}: string" for x in ("air temperature", "air humidity", "wind speed", "wind direction"))
LABEL_SCHEMA = f"""struct<drone: struct<sound_source: string, type: string, movement: string, rotation: string, distance: string, height: string, azimuth: string>, start_recording_time: string, end_recording_time: string,
weather_data: struct<measurements: struct<{_WEATHER}>>, microphone_array: struct<center_latitude: string, center_longitude: string>>"""


def by_label_json(rule: Rule, files: DataFrame, texts: DataFrame) -> DataFrame:
    """texts: ``relative_path, text`` of label.json files. ``output.wav`` beside a label counts, else its first audio file."""
    path = F.col("relative_path")
    audio = files.where(parsing.suffix(path).isin(*parsing.AUDIO_SUFFIXES)).withColumn("home", parsing.parent(path))
    order = F.struct((F.lower(parsing.base_name(path)) != "output.wav").alias("other"), path.alias("path"))
    chosen = audio.groupBy("home").agg(F.min_by(F.struct("relative_path", "size_bytes", "sha256"), order).alias("f"))
    labels = texts.select(parsing.parent(path).alias("home"), F.from_json(parsing.json_text(F.col("text")), LABEL_SCHEMA, {"mode": "PERMISSIVE"}).alias("j")).withColumn("label", parsing.sound_label(F.col("j.drone.sound_source")))
    joined = labels.where("label IS NOT NULL").join(chosen, "home").select("home", "label", "j", "f.*")
    number = lambda name: parsing.first_number(F.col(f"j.{name}"))
    weather = lambda name: F.coalesce(number(f"weather_data.measurements.`{name}`"), number(f"weather_data.measurements.{name.replace(' ', '_')}"))
    return _rows(joined, F.lit(rule.name), F.col("label"), F.lit("label_json:sound_source"), F.concat(F.lit(rule.name + ":"), F.col("home")), facts={
        "drone_type": F.col("j.drone.type"), "movement": F.col("j.drone.movement"), "rotation": F.col("j.drone.rotation"), "distance_m": number("drone.distance"), "height_m": number("drone.height"), "azimuth_deg": number("drone.azimuth"),
        "recording_start": F.col("j.start_recording_time"), "recording_end": F.col("j.end_recording_time"), "temperature_c": weather("air temperature"), "humidity_percent": weather("air humidity"), "wind_speed_ms": weather("wind speed"), "wind_direction_deg": weather("wind direction"),
        "latitude": number("microphone_array.center_latitude"), "longitude": number("microphone_array.center_longitude"),
    })


def by_annotations(rule: Rule, files: DataFrame, annotations: DataFrame) -> DataFrame:
    """annotations: ``file_name, fold, category, source_id``. Listed files that don't exist are dropped; see ``missing_audio``."""
    path = _annotated_path(rule.name)
    listed = annotations.select(path.alias("relative_path"), F.trim("fold").alias("fold"), "category", F.trim("source_id").alias("source_id"))
    joined = listed.join(files, "relative_path")
    return _rows(joined, F.lit(rule.name), F.lit(0), F.lit("official_metadata:no_drone"), F.concat(F.lit(rule.name + ":"), F.col("source_id")), F.col("category"), F.col("fold"))


def _annotated_path(dataset: str) -> Column:
    return F.concat(F.lit("wav_files/"), F.trim("file_name")) if dataset == "esc50" else F.concat(F.lit("fold"), F.trim("fold"), F.lit("/"), F.trim("file_name"))


def missing_audio(rule: Rule, files: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotated files that the listing lacks."""
    return annotations.select(_annotated_path(rule.name).alias("relative_path")).join(files, "relative_path", "left_anti")


Adapter = Callable[..., DataFrame]
ADAPTERS: dict[str, Adapter] = {"drone_audio": by_directory, "al_emadi": by_directory, "ddl": by_ddl_name, "kaist": by_kaist_name, "uavirbase": by_label_json, "esc50": by_annotations, "urbansound8k": by_annotations}


def register(name: str, adapter: Adapter) -> None:
    ADAPTERS[name] = adapter


def rows_of(rule: Rule, *inputs: DataFrame) -> DataFrame:
    """The rows of a dataset by its adapter."""
    if rule.name not in ADAPTERS:
        raise KeyError(f"no adapter for {rule.name!r}; known: {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[rule.name](rule, *inputs)


def skipped(rule: Rule, files: DataFrame, rows: DataFrame) -> DataFrame:
    """``(dataset, n_files, n_rows, n_skipped)``: audio files listed, read into rows and left out, as they fit no rule of the dataset."""
    audio = files.where(parsing.suffix(F.col("relative_path")).isin(*parsing.AUDIO_SUFFIXES)).agg(F.count("*").alias("n_files"))
    both = audio.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n_rows"))))  # one row each
    return both.select(F.lit(rule.name).alias("dataset"), "n_files", "n_rows", (F.col("n_files") - F.col("n_rows")).alias("n_skipped"))


def with_label(rows: DataFrame, label: int, strict: bool = False) -> DataFrame:
    """The rows of one label. ``strict`` raises at run time if there is another."""
    if strict:
        return rows.where(F.when(F.col("binary_label") == label, True).otherwise(F.raise_error(F.concat(F.lit("unexpected label in "), F.col("relative_path")))))
    return rows.where(F.col("binary_label") == label)
