"""Names, identifiers and numbers with units, read by patterns. A text that doesn't fit gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonarmill.functions.keys import filled

# fixed values: the names of recordings in the two drone collections, and what their codes stand for
DDL_NAME = r"(?i)^(\d{14})(MINI|PRO4|XXXX)(\d{3})(\d{3})(\d{3})(\d{4})([RS])(\d{6})-(T\d{3})-(\d{6})$"
KAIST_NAME = r"(?i)^([ABC])[_-](CC|F|B|R|L|C)[_-](N|MF[1-4]|PC[1-4])[_-]([^_-]+)[_-](.+?)[_-]([^_-]+)[_-](-?\d+(?:\.\d+)?)(?:dB)?$"
KAIST_CHANNEL = r"(?i)[_-](?:mic[12]|ch[12])$"
DDL_DRONES = {"MINI": "DJI Mini 2", "PRO4": "DJI Phantom 4 Pro"}
KELVIN = 273.15
AUDIO_SUFFIXES = (".wav", ".mp3", ".flac", ".ogg", ".m4a")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), "(?<=.)\\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), ".(\\.[^.]*)$", 1))


def parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def leaves_root(path: Column) -> Column:
    """Whether a relative path climbs out of its root."""
    return path.rlike("(^|/)\\.\\.(/|$)") | path.startswith("/")


def relative_to(path: Column, root: str) -> Column:
    return F.when(path.startswith(root.rstrip("/") + "/"), F.substring(path, len(root.rstrip("/")) + 2, 1 << 30))


def first_number(text: Column) -> Column:
    """The first run of digits, points and minus signs as a number: ``4.6 C`` is 4.6, ``--`` is null."""
    return F.regexp_extract(text, "[0-9.-]+", 0).try_cast("double")


def id_parts(segment_id: Column) -> Column:
    """``recording, number`` by the last colon; without one the whole is the recording and the number is empty."""
    whole = segment_id.rlike(":")
    return F.struct(F.when(whole, F.regexp_extract(segment_id, "(?s)^(.*):([^:]*)$", 1)).otherwise(segment_id).alias("recording"), F.when(whole, F.regexp_extract(segment_id, "(?s)^(.*):([^:]*)$", 2)).otherwise("").alias("number"))


def inferred_recording(segment_id: Column) -> Column:
    """``recording, method``: the part before a final ``:<digits>``, or else the whole id; empty ids say so."""
    text = F.trim(segment_id)
    fits = text.rlike("^(.*\\S.*):(\\d+)$")
    return F.when(filled(text).isNull(), F.struct(F.lit("").alias("recording"), F.lit("empty_segment_id").alias("method"))).when(fits, F.struct(F.trim(F.regexp_extract(text, "^(.*):(\\d+)$", 1)).alias("recording"), F.lit("segment_id_hash_without_index").alias("method"))).otherwise(F.struct(text.alias("recording"), F.lit("full_segment_id_fallback").alias("method")))


def ddl(name: Column) -> Column:
    """What a DDL stem says; null where it isn't one. An impossible date leaves ``recording_start`` null."""
    part = lambda i: F.regexp_extract(name, DDL_NAME, i)
    kind = F.upper(part(2))
    drone = F.lit("unknown")
    for code, text in DDL_DRONES.items():
        drone = F.when(kind == code, text).otherwise(drone)
    origin = F.concat(F.lit("ddl:filename_metadata:sample_type="), F.upper(part(7)), F.lit(":flight="), part(8), F.lit(":recording="), part(9), F.lit(":sequence="), part(10))
    fields = F.struct(
        F.when(kind == "XXXX", 0).otherwise(1).alias("binary_label"), drone.alias("drone_type"), part(3).cast("double").alias("azimuth_deg"), part(4).cast("double").alias("distance_m"), part(5).cast("double").alias("height_m"),
        (part(6).cast("double") / 10 - KELVIN).alias("temperature_c"), F.try_to_timestamp(part(1), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz").alias("recording_start"), origin.alias("label_origin"),
    )
    return F.when(name.rlike(DDL_NAME), fields)


def kaist(name: Column) -> Column:
    """What a KAIST stem says, after a channel suffix is taken off; null where it isn't one. Fault, background and SNR included."""
    text = F.regexp_replace(name, KAIST_CHANNEL, "")
    part = lambda i: F.regexp_extract(text, KAIST_NAME, i)
    movement = F.upper(part(2))
    fields = F.struct(
        F.lit(1).alias("binary_label"), F.upper(part(1)).alias("drone_type"), movement.alias("movement"), F.when(movement.isin("C", "CC"), movement).otherwise("").alias("rotation"), F.upper(part(3)).alias("fault"), part(4).alias("drone_index"), part(5).alias("background"), part(6).alias("background_index"), part(7).cast("double").alias("snr_db"),
    )
    return F.when(text.rlike(KAIST_NAME), fields)


def json_text(text: Column) -> Column:
    """A JSON text without its byte-order mark; one that is a JSON string holds the text itself."""
    mark = F.lit("\ufeff")
    bare = F.ltrim(text, mark)
    return F.when(F.startswith(F.ltrim(bare), F.lit('"')), F.ltrim(F.get_json_object(bare, "$"), mark)).otherwise(bare)


def sound_label(source: Column) -> Column:
    """1 for a drone, 0 for ambient sound, null for anything else."""
    text = F.lower(F.trim(source))
    return F.when(text == "drone", 1).when(text.isin("ambient noise", "ambient", "background"), 0)


def _fixed(number: Column, places: int) -> Column:
    """With so many places; a tie goes to the even digit, where the JVM's own formatting goes up."""
    return F.format_string(f"%.{places}f", F.bround(number, places))


def bytes_text(n: Column) -> Column:
    """``512.0 B``, ``1.5 KB`` and so on to TB."""
    size = n.cast("double")
    out = F.concat(_fixed(size / 1024**4, 1), F.lit(" TB"))
    for power, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        out = F.when(size < 1024 ** (power + 1), F.concat(_fixed(size / 1024**power, 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def clock_text(seconds: Column) -> Column:
    """``mm:ss``, with hours in front only if there are any; negative times are 0."""
    whole = F.floor(F.greatest(F.lit(0.0), seconds.cast("double"))).cast("bigint")
    short = F.format_string("%02d:%02d", F.floor(whole / 60) % 60, whole % 60)
    return F.when(whole >= 3600, F.concat(F.format_string("%02d:", F.floor(whole / 3600)), short)).otherwise(short)


def percent_text(share: Column, places: int = 2) -> Column:
    return F.concat(_fixed(share * 100, places), F.lit("%"))


def safe_name(segment_id: Column) -> Column:
    """A segment id as a file name."""
    return F.replace(segment_id, F.lit(":"), F.lit("_"))
