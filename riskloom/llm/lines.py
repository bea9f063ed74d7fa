"""Line dedup by distinct-site spread: HyperLogLog sketches per line hash, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.text import guarded
from riskloom.session import cut_lineage


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _row_key(docs: DataFrame, site: str) -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), F.col(site), F.col(site).isNull(), F.col("text"))


def widespread(docs: DataFrame, site: str = "source", least: int = 10, margin: float = 0.25, precision: int = 10) -> DataFrame:
    """``line_hash`` of the lines that occur on at least ``least`` distinct sites. Blank lines and null sites don't count.

    Every task sketches the sites of the lines it sees and sketches merge by aggregation, so a line that stands on a
    third of all rows is one small sketch per task. Estimates further than ``margin`` from the threshold decide
    (over ten standard errors at 2**precision registers); the lines nearer to it get exact distinct counts.
    """
    seen = docs.filter(F.col(site).isNotNull() & F.col("text").isNotNull()).select(
        F.xxhash64(site).alias("site"), F.explode(_lines(F.col("text"))).alias("line")
    )
    seen = seen.filter(F.trim("line") != "").select(_hash(F.col("line")).alias("line_hash"), "site")
    # One site per line for most lines: only lines with two sites can be widespread, so only they are sketched.
    several = seen.groupBy("line_hash").agg(F.min("site").alias("a"), F.max("site").alias("b")).filter("a <> b") if least > 1 else seen
    several = cut_lineage(several.select("line_hash").distinct())
    sketched = seen.join(several, "line_hash", "left_semi").groupBy("line_hash").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(precision))).alias("sites")
    )
    spread = cut_lineage(sketched.filter(F.col("sites") >= least * (1 - margin)))
    near = spread.filter(F.col("sites") <= least * (1 + margin)).select("line_hash")
    exact = (
        seen.join(near, "line_hash", "left_semi").distinct().groupBy("line_hash").count().filter(F.col("count") >= least)
    )
    return cut_lineage(spread.filter(F.col("sites") > least * (1 + margin)).select("line_hash").unionByName(exact.select("line_hash")))


@guarded("_row", "_bad", "_lines", "line_hash")
def drop_widespread_lines(docs: DataFrame, site: str = "source", least: int = 10, **settings) -> DataFrame:
    """All rows with boilerplate lines taken out of ``text``, and ``n_lines``, ``n_removed``.

    Lines are compared by their trimmed text, kept ones stay unchanged and in order; blank lines stay. A null text
    stays null with 0 lines. Repeated documents are treated alike. Columns named like the two new ones are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    bad = widespread(docs, site, least, **settings)
    keyed = docs.select(*names).withColumn("_row", _row_key(docs, site))
    hits = keyed.select("_row", F.explode(F.array_distinct(F.transform(_lines(F.col("text")), _hash))).alias("line_hash"))
    per_row = cut_lineage(hits.join(bad, "line_hash", "left_semi").groupBy("_row").agg(F.collect_set("line_hash").alias("_bad")))
    # Always a sort-merge join: the plan, and what it shuffles, is then the same at every size.
    met = keyed.join(per_row.hint("merge"), "_row", "left").withColumn("_lines", _lines(F.col("text")))
    kept = F.when(F.col("_bad").isNull(), F.col("_lines")).otherwise(
        F.filter("_lines", lambda x: (F.trim(x) == "") | ~F.array_contains("_bad", _hash(x)))
    )
    done = met.withColumn("_kept", kept)
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines"))
    return done.select(
        *[F.when(F.col("text").isNotNull(), F.array_join("_kept", "\n")).alias("text") if c == "text" else F.col(c) for c in names],
        count.alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines") - F.size("_kept")).alias("n_removed"),
    )


def lines_sql(least: int = 10) -> str:
    return f"""
    WITH l AS (SELECT source, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents WHERE source IS NOT NULL),
    bad AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {least}),
    listed AS (SELECT coalesce(list(line), []) AS b FROM bad),
    cut AS (SELECT d.*, string_split(text, chr(10)) AS lines,
      list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(b, trim(x, ' '))) AS kept FROM documents d, listed)
    SELECT doc_id, source, CASE WHEN text IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text,
      coalesce(len(lines), 0)::INT AS n_lines, coalesce(len(lines) - len(kept), 0)::INT AS n_removed FROM cut"""
