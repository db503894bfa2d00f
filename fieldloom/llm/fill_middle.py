"""Fill-in-middle transformation by counted quantifiers: one match of a pattern of the row's own cuts a text in three."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE = r"[^\n]*\n|[^\n]+"  #: a line with its end, or the rest


def _draws(id_col: str, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of `seed:id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """The sentinels, if no text without one can make one arise where it meets another: the first character of each stands nowhere else in any."""
    if len(set(sentinels)) < 3 or not all(sentinels) or any(s[0] in t[1:] for s in sentinels for t in sentinels):
        raise ValueError("three different sentinels are needed whose first characters stand at no other place of a sentinel")
    return sentinels


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, unit: str = LINE, sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output) for every row of docs; the sentinels are of prefix, suffix and middle.

    A text has n units, the matches of the expression `unit`, which together have to be the text. Two draws by the hash of the id cut
    between units: (unit){a}+ is the prefix, (unit){b-a}+ the middle and what follows the suffix, groups of one match whose possessive
    counts are loops without a way back, so that neither the stack nor the time grows with the number of lines. form is plain for an empty text, one that
    holds a sentinel, and 100 - rate of 100 ids; of the others spm_rate of 100 are spm (suffix, prefix, middle), else psm (prefix, suffix, middle).

    A null text counts as empty and a null id as an empty one. Rows are judged by themselves: repeated ids give the same draws."""
    p, s, m = checked(sentinels)
    h = _draws(id_col, seed)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("fim_id"), text.alias("fim_text"), *[x.alias(f"h{k}") for k, x in enumerate(h, 1)])
    rows = rows.withColumn("n", F.regexp_count("fim_text", F.lit(unit)).cast("bigint"))
    holds = F.contains("fim_text", F.lit(p)) | F.contains("fim_text", F.lit(s)) | F.contains("fim_text", F.lit(m))
    plain = (F.col("fim_text") == "") | holds | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm")
    cut = [F.col(k) % (F.col("n") + 1) for k in ("h1", "h2")]
    a, b = F.least(*cut), F.greatest(*cut)
    group = lambda times: F.concat(F.lit(f"((?:{unit}){{"), times.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"\A"), group(a), group(b - a), F.lit(r"((?s:.*))\z"))
    quoted = [re.sub(r"([\\$])", r"\\\1", x) for x in (p, s, m)]
    as_psm, as_spm = (F.lit(x) for x in ("{0}$1{1}$3{2}$2".format(*quoted), "{1}$3{0}$1{2}$2".format(*quoted)))
    rows = rows.select("fim_id", "fim_text", "n", form.alias("form"), pattern.alias("pattern"))
    output = F.when(F.col("form") == "plain", F.col("fim_text")).otherwise(F.regexp_replace("fim_text", F.col("pattern"), F.when(F.col("form") == "psm", as_psm).otherwise(as_spm)))
    rows = rows.select("fim_id", "n", "form", output.alias("output"))
    at = {k: F.locate(v, F.col("output")) for k, v in zip("psm", sentinels)}
    before = F.when(F.col("form") == "psm", at["s"] - 1 - len(p)).when(F.col("form") == "spm", at["m"] - at["p"] - len(p))
    middle = F.when(F.col("form") != "plain", F.char_length("output") - at["m"] - len(m) + 1)
    return rows.select(F.col("fim_id").alias(id_col), "n", "form", before.cast("bigint").alias("prefix_chars"), middle.cast("bigint").alias("middle_chars"), "output")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that an output of that form was made from, by the places of its sentinels alone."""
    p, s, m = checked(sentinels)
    at = {k: F.locate(v, output) for k, v in zip("psm", sentinels)}
    part = lambda start, end: F.substring(output, start, end - start)
    middle = F.substring(output, at["m"] + len(m), F.char_length(output))
    psm = F.concat(part(F.lit(len(p) + 1), at["s"]), middle, part(at["s"] + len(s), at["m"]))
    spm = F.concat(part(at["p"] + len(p), at["m"]), middle, part(F.lit(len(s) + 1), at["p"]))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
