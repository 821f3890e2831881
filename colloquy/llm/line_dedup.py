"""Line dedup by overlapping three-line windows (DataFrame functions only).

Lines that are empty or white space only are skipped when windows are formed;
they share the fate of the line before them.  Lines compare by their trimmed
text.  Every window of three consecutive lines is hashed (128 bits); a window
found more than once anywhere in the corpus stays at its first place and its
later occurrences are removed: a line goes when any such occurrence covers it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once, packed, row_key, unpacked

WINDOW = 3
SPACES = " \t\n\x0b\f\r"


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """All rows of ``df`` with the deduplicated ``text_col``, ``n_lines`` and ``n_removed``.

    ``n_lines`` counts the lines with text before, ``n_removed`` those removed.
    Places are ordered by id (null first), then by the row's digest, then by
    line; rows equal in id and text are one place and stay or go alike.  A
    text with fewer than ``window`` lines has no window and stays as it is, as
    does any text without removals; a null text stays null with no lines.  A
    window that overlaps its own repetition loses the lines the repetition
    covers.  Columns named ``n_lines`` or ``n_removed`` are replaced.
    """
    names = df.columns
    k1, k2 = row_key([F.col("rec")[id_col], F.col("rec")[text_col]])
    docs = packed(df).withColumns({"k1": k1, "k2": k2})

    # lines with text and the stretch they stand for: themselves and the blank lines after them
    split = F.split(F.col("rec")[text_col], "\n", -1)
    trimmed = lambda line: F.btrim(line, F.lit(SPACES))
    lines = once(docs.select("k1", "k2", F.col("rec")[id_col].alias("id"), F.filter(
        F.transform(split, lambda line, i: F.struct(i.alias("at"), trimmed(line).alias("line"))),
        lambda x: x["line"] != "").alias("x")), "x")
    shifted = [F.slice("x", k + 1, F.greatest(F.size("x") - k, F.lit(0))).alias(f"x{k}") for k in range(window + 1)]
    windows = once(lines.filter(F.size("x") >= window).select("k1", "k2", "id", F.arrays_zip(*shifted).alias("z")), "z")
    # a window is followed by null entries at the end of the text, where it is no window
    same = [F.col("w")[f"x{k}"]["line"] for k in range(window)]
    windows = (windows.select("k1", "k2", "id", F.posexplode("z").alias("j", "w"))
               .filter(F.col("w")[f"x{window - 1}"].isNotNull())
               .select("k1", "k2", "id", "j", F.xxhash64(*same).alias("w1"), F.xxhash64(F.lit(1), *same).alias("w2"),
                       F.array(*[F.struct(
                           F.when((F.col("j") == 0) & F.lit(k == 0), 0).otherwise(F.col("w")[f"x{k}"]["at"]).alias("a"),
                           F.col("w")[f"x{k + 1}"]["at"].alias("b")) for k in range(window)]).alias("covers")))
    place = F.struct("id", "k1", "k2", "j")
    repeated = (windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("first"))
                .filter("c > 1").select("w1", "w2", "first"))
    # the covered stretches of later occurrences, merged: each line once
    later = (windows.join(repeated, ["w1", "w2"]).filter(~place.eqNullSafe(F.col("first")))
             .select("k1", "k2", F.explode("covers").alias("c"))
             .groupBy("k1", "k2").agg(F.collect_set("c").alias("gone")))

    out = once(docs.join(later, ["k1", "k2"], "left").select("rec", "gone", split.alias("lines")), "lines")
    # a last line has no next one: its stretch ends with the text
    places = F.flatten(F.transform("gone", lambda c: F.sequence(c["a"], F.coalesce(c["b"], F.size("lines")) - 1)))
    out = once(out.withColumn("kept", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), places)), "kept")
    text = F.array_join(F.transform("kept", lambda i: F.element_at("lines", i + 1)), "\n")
    full = F.size(F.filter("lines", lambda line: trimmed(line) != ""))
    out = out.select(
        F.col("rec").withField(f"`{text_col}`", F.when(F.col("gone").isNull(), F.col("rec")[text_col]).otherwise(text))
        .alias("rec"),
        F.when(F.col("lines").isNull(), 0).otherwise(full).cast("bigint").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("bigint").alias("n_removed"))
    return unpacked(out, names, ["n_lines", "n_removed"])
