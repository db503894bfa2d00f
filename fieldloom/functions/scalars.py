"""Column expressions: ids, names, values, vectors. All stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (substring, cohort) in order of precedence, the words for a gender, and the sizes that networks may have.
COHORTS = [("AF", "AF"), ("YRM", "SickValve"), ("NORM", "Leuven_norm"), ("BBB", "Leuven_BBB"), ("VT", "VT"), ("S", "ilearnHeart")]
FEMALE, MALE = ["F", "FEMALE", "DONNA", "WOMAN"], ["M", "MALE", "UOMO", "MAN"]
DEPTHS, WIDTHS, LATENT_SIZES = [3, 5, 7], [64, 128, 256, 512], [16, 32, 64, 128]


def uniform(*key: Column | str) -> Column:
    """A number in (0, 1) that depends on the key alone: the same in any partitioning, and in other SQL engines."""
    text = F.concat_ws("|", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def norm_id(id_: Column, cohort: Column) -> Column:
    """An id in the form that its cohort's tables share; the cohort by its name or by the mark of its ids.

    BBB (Leuven_BBB): the first run of digits, else the id; YRM (SickValve): YRM with its digits, upper-cased, else upper-cased; others upper-cased."""
    id_ = stripped(id_)
    digits = F.nullif(F.regexp_extract(id_, r"(\d+)", 1), F.lit(""))
    yrm = F.nullif(F.regexp_extract(F.upper(id_), r"(YRM\d+)", 1), F.lit(""))
    return F.when(cohort.isin("BBB", "Leuven_BBB"), F.coalesce(digits, id_)).when(cohort.isin("YRM", "SickValve"), F.coalesce(yrm, F.upper(id_))).otherwise(F.upper(id_))


def clean_id(id_: Column) -> Column:
    """Stripped and upper-cased; a number loses its .0, any other text keeps it; empty for null and NaN."""
    out = F.upper(F.regexp_replace(stripped(id_), r"^(\d+)\.0$", "$1"))
    return F.when(id_.isNull() | (out == "NAN"), "").otherwise(out)


def parse_gender(text: Column) -> Column:
    """F or M: a lone 1 or 0 first, then words in any case; else null."""
    flag = F.regexp_extract(text, r"\b([01])\b", 1)
    word = F.upper(stripped(text))
    return F.when(flag == "1", "F").when(flag == "0", "M").when(word.isin(FEMALE), "F").when(word.isin(MALE), "M")


def cohort_of(id_: Column) -> Column:
    """The name of the cohort whose mark, in the order of COHORTS, is the first that stands anywhere in the id, in any case; null without one."""
    out = F.lit(None).cast("string")
    for part, name in reversed(COHORTS):
        out = F.when(F.upper(id_).contains(part), name).otherwise(out)
    return out


def gender_from_id(id_: Column) -> Column:
    return F.when(F.upper(id_).contains("F"), "F").otherwise("M")


def scene_of(file: Column) -> Column:
    """The scene in a file name: what stands before -epi_lv_rv_, _MRI_like_ or the ending of slice samples, else before the first -; null for other names (see scene_error)."""
    base = F.regexp_replace(F.substring_index(file, "/", -1), r"\.npy$", "")
    marked = F.nullif(F.regexp_extract(base, r"^(.+?)(?:-epi_lv_rv_.*|_MRI_like_.*|_(?:three_axis_)?mri_(?:grid_)?samples)$", 1), F.lit(""))
    return F.coalesce(marked, F.when(base.contains("-"), F.nullif(F.substring_index(base, "-", 1), F.lit(""))))


def scene_error(file: Column) -> Column:
    """What the error row of a file says whose name holds no scene; null for others."""
    return F.when(scene_of(file).isNull(), F.concat(F.lit("unexpected file name: "), F.coalesce(file, F.lit("null"))))


def parse_value(text: Column) -> Column:
    """A number, or the first of a bracketed list; null if it isn't one."""
    return F.split(F.trim(F.regexp_replace(text, r"[\[\]]", "")), r"[,\s]+")[0].try_cast("double")


def sampling_combination(name: Column) -> list[Column]:
    """sigma, lambda and rho of S_a-L_b-R_c; null for any other form of name."""
    return [F.nullif(F.regexp_extract(stripped(name), r"^S_([0-9.]+)-L_([0-9.]+)-R_([0-9.]+)$", k), F.lit("")).try_cast("double") for k in (1, 2, 3)]


NETWORK = r"^.*_D(\d+)_W(\d+)_L(\d+)$"


def network_combination(name: Column) -> list[Column]:
    """depth, width and latent size of ..._Dn_Wn_Ln; null for any other form of name."""
    return [F.nullif(F.regexp_extract(name, NETWORK, k), F.lit("")).try_cast("int") for k in (1, 2, 3)]


def combination_error(name: Column) -> Column:
    """Why a name is no combination of a network: its form, or the first of depth, width and latent size outside its domain; null if it is one."""
    parts = network_combination(name)
    out = F.when(F.coalesce(F.rlike(name, F.lit(NETWORK)), F.lit(False)) == F.lit(False), F.concat(F.lit("unknown combination: "), F.coalesce(name, F.lit("null"))))
    for part, what, allowed in zip(parts, ("depth", "width", "latent size"), (DEPTHS, WIDTHS, LATENT_SIZES)):
        out = out.when(~F.coalesce(part.isin(allowed), F.lit(False)), F.concat(F.lit(f"invalid {what}: "), name))
    return out


def nearest_label(value: Column, nominal: list[float]) -> Column:
    """The nominal value nearest to value; of two, the smaller."""
    return F.array_min(F.array(*[F.struct(F.abs(value - n), F.lit(n).alias("n")) for n in nominal]))["n"]


def rename_suffix(names: Column, old: str, new: str) -> Column:
    return F.transform(names, lambda x: F.replace(x, F.lit(old), F.lit(new)))


def dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def minus(a: list[Column], b: list[Column]) -> list[Column]:
    return [x - y for x, y in zip(a, b)]


def norm(a: list[Column]) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: list[Column]) -> list[Column]:
    """Null for a vector of length 0."""
    n = F.nullif(norm(a), F.lit(0.0))
    return [x / n for x in a]


def positional_encode(x: Column, k: int, scale: float = 1.0) -> Column:
    """x, then sin and cos of 2**i * pi * x / scale for i below k."""
    waves = [f(F.lit(2.0**i * math.pi) * x / scale) for i in range(k) for f in (F.sin, F.cos)]
    return F.array(x, *waves)


def anatomical_axes(c: list[Column], a: list[Column], t: list[Column]) -> tuple[list[Column], list[Column], list[Column]]:
    """e1 from C to A; e2 towards T at a right angle; e3 = e1 x e2; e2 made again from both."""
    e1 = unit(minus(a, c))
    w = minus(t, c)
    along = dot(w, e1)
    e2 = unit([x - along * y for x, y in zip(w, e1)])
    e3 = unit(cross(e1, e2))
    return e1, cross(e3, e1), e3


def finite(column: Column | str) -> Column:
    """Neither null nor NaN nor infinite."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))
