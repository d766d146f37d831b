"""Fill-in-the-middle by relations: units of a text as rows, running sums of their lengths, cuts that meet units by ordinal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartolex.llm.common import cut, drop_cut, sized

#: A unit, and a run of units that is one row at first: rows of a text are about units / BLOCK + 2 * BLOCK.
UNIT = "[A-Za-z]++|[^A-Za-z]"
BLOCK = 32
#: Fixed marks of the contract.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def n_units(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[A-Za-z]+", "a"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: a text that is cut holds no mark, so each mark stands in its output once."""
    head, middle = F.substring_index(output, SUFFIX, 1), F.substring_index(output, MIDDLE, -1)
    prefix = F.substr(head, F.lit(len(PREFIX) + 1))
    suffix = F.substring_index(F.substring_index(output, SUFFIX, -1), MIDDLE, 1)
    spm_suffix = F.substr(F.substring_index(output, PREFIX, 1), F.lit(len(SUFFIX) + 1))
    spm_prefix = F.substring_index(F.substring_index(output, PREFIX, -1), MIDDLE, 1)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(spm_prefix, middle, spm_suffix)).otherwise(output)


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plain_from: int = 90, spm_below: int = 20, seed: str = "1", block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n (units), form, prefix_chars, middle_chars, output.

    Four numbers are drawn from the sha256 of ``seed:doc_id``. The smaller and the larger of the first two, each modulo n + 1,
    are the units before the middle and up to its end; texts that are empty or hold a mark are left plain, and of the others
    those whose third number has a hundredth part of ``plain_from`` or more; of the rest, those whose fourth is below
    ``spm_below`` put the suffix first. Null texts are empty; a null id is drawn like an empty one; rows that repeat an id have
    cuts of their own if their texts differ, equal rows have equal ones. Columns of other names are not used. An empty table
    gives no rows.

    Texts become rows of ``block`` units, whose lengths are summed along the text by a window; cut requests meet them by ordinal,
    and what a request meets becomes rows of single units, summed again. All of it stays with the one exchange by text that the
    first sums need: a block is its length there, and its characters only where a cut falls into it. What comes back for a text
    are two offsets. Texts move in the last join alone, and there only once the offsets are too many to broadcast. Rows that
    repeat are one before they are exchanged.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("_id"), name.alias("_name"), whole.alias("_t"))
    # 128 bits of the id and the text name a row and its copies
    rows = rows.select("*", F.xxhash64("_name", "_t").alias("k1"), F.xxhash64(F.lit(1), "_t", "_name").alias("k2"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), "_name"), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    marked = F.col("_t").contains(PREFIX) | F.col("_t").contains(SUFFIX) | F.col("_t").contains(MIDDLE)
    drawn = rows.withColumn("n", n_units(F.col("_t")).cast("long")).withColumn("form", F.when((F.col("_t") == "") | marked | (h[2] % 100 >= plain_from), "plain").when(h[3] % 100 < spm_below, "spm").otherwise("psm"))
    ends = [F.when(F.col("form") != "plain", x % (F.col("n") + 1)) for x in h[:2]]
    drawn = drawn.withColumn("a", F.least(*ends)).withColumn("b", F.greatest(*ends))
    # a row for each text: its units and its cuts
    each = cut(drawn.groupBy("k1", "k2").agg(*[F.min(c).alias(c) for c in ("n", "form", "a", "b")], F.count("*").alias("copies")), "cuts")

    texts = drawn.where("form <> 'plain'").select("k1", "k2", "a", "b", "_t")
    again = cut(each.where("copies > 1 and form <> 'plain'").select("k1", "k2"), "repeated")
    if again.limit(1).count():
        once = texts.join(sized(again, 32), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(*[F.min(c).alias(c) for c in ("a", "b", "_t")])
        texts = texts.join(sized(again, 32), ["k1", "k2"], "left_anti").unionByName(once)
    # the last unit before a cut is number a or b from 1; a cut before all units needs none
    falls = lambda c: (F.col(c) > F.col("pos") * block) & (F.col(c) <= (F.col("pos") + 1) * block)
    blocks = texts.select("k1", "k2", "a", "b", F.posexplode(F.regexp_extract_all("_t", F.lit(f"(?:{UNIT}){{1,{block}}}"), F.lit(0))).alias("pos", "part"))
    blocks = blocks.select("k1", "k2", "pos", F.length("part").alias("size"), F.when(falls("a") | falls("b"), F.col("part")).alias("part")).repartition("k1", "k2")
    along = Window.partitionBy("k1", "k2").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = blocks.withColumn("start", F.sum("size").over(along) - F.col("size")).where("part is not null")

    requests = each.where("form <> 'plain'").select("k1", "k2", F.posexplode(F.array("a", "b")).alias("which", "ordinal"))
    meets = (F.col("ordinal") > F.col("pos") * block) & (F.col("ordinal") <= (F.col("pos") + 1) * block)
    met = held.join(requests, ["k1", "k2"]).where(meets)
    units = met.select("k1", "k2", "which", "ordinal", "pos", "start", F.posexplode(F.regexp_extract_all("part", F.lit(UNIT), F.lit(0))).alias("i", "unit"))
    inside = Window.partitionBy("k1", "k2", "which").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    units = units.select("k1", "k2", "which", "ordinal", (F.col("pos") * block + F.col("i") + 1).alias("at"), (F.col("start") + F.sum(F.length("unit")).over(inside)).alias("end"))
    end = lambda i: F.max(F.when(F.col("which") == i, F.col("end")))
    ended = units.where("at = ordinal").groupBy("k1", "k2").agg(end(0).alias("p"), end(1).alias("q"))
    offsets = cut(each.select("k1", "k2", "n", "form").join(ended, ["k1", "k2"], "left"), "offsets")
    drop_cut(each)
    drop_cut(again)

    out = rows.join(sized(offsets, 72), ["k1", "k2"])
    p, q = (F.coalesce(F.col(c), F.lit(0)).cast("int") for c in ("p", "q"))
    parts = [F.substr(F.col("_t"), F.lit(1), p), F.substr(F.col("_t"), p + 1, q - p), F.substr(F.col("_t"), q + 1)]
    psm, spm = F.concat(F.lit(PREFIX), parts[0], F.lit(SUFFIX), parts[2], F.lit(MIDDLE), parts[1]), F.concat(F.lit(SUFFIX), parts[2], F.lit(PREFIX), parts[0], F.lit(MIDDLE), parts[1])
    made = F.col("form") != "plain"
    return out.select(
        F.col("_id").alias("doc_id"), "n", "form", F.when(made, p).cast("long").alias("prefix_chars"), F.when(made, q - p).cast("long").alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("_t")).alias("output"),
    )
