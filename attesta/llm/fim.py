"""Fill-in-the-middle: texts cut into prefix, middle and suffix and rearranged
between sentinels, all with the engine's own functions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from .storage import free_names

#: A unit is a word with the blanks before it; blanks at a text's end are one too.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: What stands before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
ADDED = ("n", "form", "prefix", "middle", "suffix", "output")


def draws(key: Column, seed: int, count: int = 4) -> list[Column]:
    """Numbers below 2**32 that depend on seed and key alone: the 8-digit
    groups of the key's SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(count)]


def _meet(a: str, b: str) -> bool:
    """Whether a sentinel could arise where a text meets one of them."""
    return (a != b and b in a) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b))))


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42,
    percent: int = 50, spm_percent: int = 80, sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """``docs`` with n (units of the text), form, prefix, middle, suffix and
    output; names that are taken get underscores.

    Both cuts fall between units, at each of the n + 1 places alike. The form
    is ``plain`` (the output is the text; the parts are null) for empty texts,
    for texts that hold a sentinel, and for all but ``percent`` of the rest;
    else ``spm`` (suffix, prefix, middle) for ``spm_percent`` of them and
    ``psm`` for the others.

    Null texts are empty; a null id draws as an empty one; repeated rows are
    treated alike; an empty table gives no rows. Whole texts are cut, however
    long. Projections only: nothing is shuffled.
    """
    if len(set(sentinels)) < 3 or not all(sentinels) or any(_meet(a, b) for a, b in product(sentinels, repeat=2)):
        raise ValueError("sentinels must differ, and none may begin as one ends")
    name = free_names(docs.columns, [*ADDED, "whole", "units", "draw", "at"])
    own = [F.col(f"`{c}`") for c in docs.columns]
    whole, units, draw, at, form = (F.col(name[c]) for c in ("whole", "units", "draw", "at", "form"))
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    d = docs.select(*own, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias(name["whole"]), F.array(*draws(key, seed)).alias(name["draw"]))
    d = d.withColumn(name["units"], F.regexp_extract_all(whole, F.lit(UNIT), 0))
    n, held = F.size(units), F.lit(False)
    for s in sentinels:
        held = held | F.contains(whole, F.lit(s))
    kind = F.when((whole == "") | held | (draw[2] % 100 >= percent), "plain").when(draw[3] % 100 < spm_percent, "spm").otherwise("psm")
    cuts = F.array_sort(F.transform(F.slice(draw, 1, 2), lambda h: (h % (n + 1)).cast("int")))
    d = d.select(*own, whole, units, n.cast("long").alias(name["n"]), kind.alias(name["form"]), cuts.alias(name["at"]))

    def part(c: str, start: Column, length: Column) -> Column:
        return F.when(form != "plain", F.array_join(F.slice(units, start, length), "")).alias(name[c])

    parts = part("prefix", F.lit(1), at[0]), part("middle", at[0] + 1, at[1] - at[0]), part("suffix", at[1] + 1, F.size(units) - at[1])
    d = d.select(*own, whole, name["n"], name["form"], *parts)
    prefix, suffix, middle = (F.concat(F.lit(s), F.col(name[c])) for s, c in zip(sentinels, ("prefix", "suffix", "middle")))
    output = F.when(form == "plain", whole).when(form == "spm", F.concat(suffix, prefix, middle)).otherwise(F.concat(prefix, suffix, middle))
    return d.select(*own, *[name[c] for c in ADDED[:-1]], output.alias(name["output"]))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text again, by parsing the sentinels of the output."""
    parts = F.split(output, "|".join(f"\\Q{s}\\E" for s in sentinels), -1)
    spm, psm = F.concat(parts[2], parts[3], parts[1]), F.concat(parts[1], parts[3], parts[2])
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)
