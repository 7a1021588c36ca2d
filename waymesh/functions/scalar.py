"""Column functions for ids, codes, flags and timestamps of road layers."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mean "no value" in id fields.
NULL_WORDS = ("", "none", "null", "nan", "na", "n/a", "[]")

# Lane arrow codes and the turn tokens they stand for.
ARROW_TOKENS = {
    "9": ("uninvestigated",), "a": ("straight",), "b": ("left",), "c": ("right",), "d": ("uturn",),
    "e": ("straight", "uturn"), "f": ("straight", "right"), "g": ("straight", "left"),
    "h": ("left", "straight", "right"), "i": ("uturn", "straight", "right"),
    "j": ("uturn", "left", "straight"), "k": ("left", "right"), "l": ("uturn", "left"),
    "m": ("uturn", "left", "right"), "n": ("uturn", "right"), "o": ("empty",),
    "p": ("left", "straight", "right", "uturn"), "r": ("slight_left",), "s": ("slight_right",),
    "t": ("straight", "slight_left"), "u": ("left", "slight_left"), "v": ("right", "slight_left"),
    "w": ("uturn", "slight_left"), "x": ("straight", "slight_right"), "y": ("left", "slight_right"),
    "z": ("right", "slight_right"), "0": ("uturn", "slight_right"), "1": ("slight_left", "slight_right"),
    "2": ("straight", "left", "slight_left"), "3": ("straight", "left", "slight_right"),
    "4": ("straight", "right", "slight_left"), "5": ("straight", "right", "slight_right"),
}

# Bits of the formway mask.
ADVANCE_RIGHT_BIT, ADVANCE_LEFT_BIT, UTURN_BIT = 128, 256, 1024


def normalize_id(c: Column) -> Column:
    """Trimmed id text; blank becomes null and ``123.0`` becomes ``123``."""
    text = F.trim(c.cast("string"))
    return F.when(text != "", F.regexp_replace(text, r"^([0-9]+)\.0+$", "$1"))


def normalize_id_strict(c: Column) -> Column:
    """As ``normalize_id`` but quotes are stripped and null words become null."""
    text = F.regexp_replace(F.trim(c.cast("string")), "^[\"']+|[\"']+$", "")
    return F.when(~F.lower(text).isin(*NULL_WORDS), F.regexp_replace(text, r"^(-?[0-9]+)\.0+$", "$1"))


def normalize_mainnodeid(c: Column) -> Column:
    return F.nullif(normalize_id(c), F.lit("0"))


def parse_id_list(c: Column) -> Column:
    """Ids of a list written as JSON, a literal or with any usual separator; order kept, no repeats."""
    bare = F.regexp_replace(F.trim(c), r"^[\[\](){}]+|[\[\](){}]+$", "")
    ids = F.transform(F.split(bare, r"[,;|\\\s]+"), normalize_id_strict)
    return F.coalesce(F.array_distinct(F.filter(ids, lambda i: i.isNotNull())), F.array().cast("array<string>"))


def join_ids(ids: Column, separator: str = ",") -> Column:
    """Ids joined in numeric-first order."""
    return F.array_join(F.transform(F.array_sort(F.transform(ids, id_sort_key)), lambda k: k["text"]), separator)


def id_sort_key(c: Column) -> Column:
    """Orders numbers before text and numbers by value."""
    number = c.try_cast("bigint")
    return F.struct(number.isNull().cast("int").alias("is_text"), F.coalesce(number, F.lit(0)).alias("number"),
                    c.alias("text"))


def kind_tokens(kind: Column) -> Column:
    """Distinct road-kind tokens, digits padded to four places."""

    def token(raw: Column) -> Column:
        text = F.regexp_replace(F.trim(raw), r"^([0-9]+)\.0$", "$1")
        return F.when(text.rlike("^[0-9]{1,3}$"), F.lpad(text, 4, "0")).otherwise(text)

    return F.array_distinct(F.filter(F.transform(F.split(kind, r"\|"), token), lambda t: t != ""))


def kind_levels(kind: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(kind_tokens(kind), lambda t: F.length(t) >= 2),
                                        lambda t: F.substring(t, 1, 2)))


def kind_has_suffix(kind: Column, suffix: str) -> Column:
    return F.exists(kind_tokens(kind), lambda t: t.endswith(suffix))


def has_bit(mask: Column, bits: int) -> Column:
    return F.coalesce(mask.cast("int").bitwiseAND(bits) != 0, F.lit(False))


def arrow_tokens(code: Column) -> Column:
    """Turn tokens of one arrow code; null for an unknown code. Case does not matter."""
    pairs = [F.lit(part) for code_, tokens in ARROW_TOKENS.items() for part in (code_, "|".join(tokens))]
    return F.split(F.element_at(F.create_map(*pairs), F.lower(F.trim(code))), r"\|")


def arrow_sequence(codes: Column) -> Column:
    return F.filter(F.transform(F.split(codes, ","), F.trim), lambda c: c != "")


def lane_reversed(road_direction: Column, lane_dir: Column) -> Column:
    """Whether lane geometry runs against the road's points; null when the direction is not 0..3."""
    return F.when(road_direction.isin(0, 1, 2), lane_dir == 3).when(road_direction == 3, lane_dir == 2)


def is_inbound(direction: Column, snode_inside: Column) -> Column:
    return F.when(direction.isin(0, 1), True).when(direction == 2, ~snode_inside).when(
        direction == 3, snode_inside).otherwise(False)


def is_outbound(direction: Column, snode_inside: Column) -> Column:
    return F.when(direction.isin(0, 1), True).when(direction == 2, snode_inside).when(
        direction == 3, ~snode_inside).otherwise(False)


def road_role(direction: Column, snode_inside: Column) -> Column:
    inbound, outbound = is_inbound(direction, snode_inside), is_outbound(direction, snode_inside)
    return F.when(inbound & outbound, "bidirectional").when(inbound, "inbound").when(
        outbound, "outbound").otherwise("none")


def directionality(sgrade: Column) -> Column:
    text = F.lower(F.trim(sgrade))
    return (F.when(text.endswith("双") | text.isin("dual", "bidirectional", "two_way", "twoway"), "dual")
            .when(text.endswith("单") | text.isin("single", "oneway", "one_way"), "single"))


def coerce_int(c: Column) -> Column:
    """Integer value of text such as ``7`` or ``7.0``; null when it is not integral."""
    number = F.trim(c.cast("string")).try_cast("double")
    return F.when(number == F.floor(number), number.try_cast("bigint"))


def timestamp_seconds(c: Column) -> Column:
    """Epoch seconds from numeric text in s, ms or µs, or from ISO text; null when it is neither."""
    number = F.trim(c).try_cast("double")
    size = F.abs(number)
    scaled = F.when(size > 1e14, number / 1e6).when(size > 1e11, number / 1e3).otherwise(number)
    finite = F.when(~F.isnan(number) & (size < float("inf")), scaled)
    return F.coalesce(finite, F.unix_micros(F.try_to_timestamp(F.trim(c))) / 1e6)


def digest_id(ids: Column, prefix: str) -> Column:
    """Stable id of a set: prefix and 16 hex digits of the sha1 over its ids in numeric-first order."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(join_ids(ids, "\x1f")), 1, 16))


def content_hash(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def confidence(score: Column, has_conflict: Column, non_geometry: Column) -> Column:
    return (F.when(has_conflict, "conflict").when((score >= 80) & (non_geometry < 55), "medium")
            .when(score >= 80, "high").when(score >= 60, "medium").when(score >= 40, "low").otherwise("reject"))


def safe_ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def rounded(c: Column, places: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return F.round(c, places) + F.lit(0.0)
