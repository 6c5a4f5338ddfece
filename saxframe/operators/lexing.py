"""Lexing and structure in Catalyst: tokens by regular expressions, depth, partners and parents by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saxframe.functions import expressions as X


def tokens(docs: DataFrame, doc_id: str | Column = "doc_id", text: str | Column = "text") -> DataFrame:
    """doc_id, seq (from 0), kind and raw of each token of content. Filters on doc_id reach the scan."""
    doc_id, text = (F.col(c) if isinstance(c, str) else c for c in (doc_id, text))
    return docs.select(doc_id.alias("doc_id"), F.posexplode(F.regexp_extract_all(text, F.lit(X.CONTENT_RE), 1)).alias("seq", "raw")).select("doc_id", "seq", X.token_kind("raw").alias("kind"), "raw")


def references(found: DataFrame) -> DataFrame:
    """The references in tokens() of text and tags: doc_id, seq, n (from 0), kind ("ref", "charref") and raw."""
    each = found.where(F.col("kind").isin("text", "start", "empty")).select("doc_id", "seq", F.posexplode(F.regexp_extract_all("raw", F.lit(X.REFERENCE_RE), 1)).alias("n", "raw"))
    return each.select("doc_id", "seq", "n", F.when(F.col("raw").startswith("&#"), "charref").otherwise("ref").alias("kind"), "raw")


def token_counts(docs: DataFrame, text: str | Column = "text") -> DataFrame:
    """Tokens by kind, counted as they are cut: partial sums meet in one small exchange."""
    text = F.col(text) if isinstance(text, str) else text
    return docs.select(F.explode(F.regexp_extract_all(text, F.lit(X.CONTENT_RE), 1)).alias("raw")).groupBy(X.token_kind("raw").alias("kind")).agg(F.count(F.lit(1)).alias("n_tokens"))


def positions(found: DataFrame) -> DataFrame:
    """tokens() with line, col and byte_index of where each begins: running sums, one exchange on doc_id."""
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    text = X.normal_lines("raw")
    breaks, size = F.length(F.regexp_replace(text, r"[^\n]+", "")), F.length(text)
    sums = found.select("*", breaks.alias("__breaks"), (size - F.length(F.substring_index(text, "\n", -1))).alias("__last"), F.coalesce(F.sum(size).over(before), F.lit(0)).alias("__at"))
    return sums.select(
        *found.columns,
        (F.coalesce(F.sum("__breaks").over(before), F.lit(0)) + 1).alias("line"),
        (F.col("__at") - F.coalesce(F.max(F.when(F.col("__breaks") > 0, F.col("__at") + F.col("__last"))).over(before), F.lit(0))).alias("col"),
        F.coalesce(F.sum(F.octet_length("raw")).over(before), F.lit(0)).alias("byte_index"),
    )


def elements(found: DataFrame) -> DataFrame:
    """Of well-formed documents' tokens, a row per element: doc_id, seq, end_seq, name, raw, depth, parent_seq, text.

    depth is a running sum of starts and ends. At one depth starts and ends alternate, so a start's
    partner is the next row there. The parent is the last start one level up. text is the element's
    own character data, joined. All windows share the partitioning on doc_id: one exchange.
    """
    order = Window.partitionBy("doc_id").orderBy("seq")
    step = F.when(F.col("kind") == "start", 1).when(F.col("kind") == "end", -1).otherwise(0)
    deep = found.where(F.col("kind").isin("start", "end", "empty", "text", "cdata")).withColumn("__after", F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    deep = deep.withColumn("depth", F.when(F.col("kind") == "start", F.col("__after")).otherwise(F.col("__after") + 1))
    at_level = Window.partitionBy("doc_id", "depth").orderBy("seq")
    # a start and what stands one level up from a child: both under the level of the child
    level = F.when(F.col("kind").isin("text", "cdata"), F.col("depth") - 1).otherwise(F.col("depth"))
    tagged = deep.where(F.col("kind").isin("start", "end", "empty")).withColumn("end_seq", F.when(F.col("kind") == "start", F.lead("seq").over(at_level)).otherwise(F.col("seq")))
    starts = tagged.where(F.col("kind") != "end")
    keyed = starts.select("*", F.explode(F.array(F.struct(F.col("depth").alias("k"), F.lit(True).alias("own")), F.struct((F.col("depth") - 1).alias("k"), F.lit(False).alias("own")))).alias("p"))
    up = Window.partitionBy("doc_id", "p.k").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parent = keyed.withColumn("parent_seq", F.last(F.when(F.col("p.own") & (F.col("kind") == "start"), F.col("seq")), ignorenulls=True).over(up)).where("NOT p.own")
    said = deep.where(F.col("kind").isin("text", "cdata", "start")).withColumn("k", F.when(F.col("kind") == "start", F.col("depth")).otherwise(level))
    inside = Window.partitionBy("doc_id", "k").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    body = F.when(F.col("kind") == "cdata", F.expr("substring(raw, 10, length(raw) - 12)")).otherwise(X.resolved("raw"))
    owned = said.withColumn("owner", F.last(F.when(F.col("kind") == "start", F.col("seq")), ignorenulls=True).over(inside)).where("kind <> 'start'").select("doc_id", F.col("owner").alias("seq"), F.struct(F.col("seq").alias("at"), body.alias("t")).alias("s"))
    text = owned.groupBy("doc_id", "seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), "").alias("text"))
    return parent.select("doc_id", "seq", "end_seq", X.tag_name("raw").alias("name"), "raw", "depth", "parent_seq").join(text, ["doc_id", "seq"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def tag_mismatches(found: DataFrame) -> DataFrame:
    """Per document the first end tag whose name isn't that of the start it closes: doc_id, seq, error_code (7)."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    step = F.when(F.col("kind") == "start", 1).otherwise(-1)
    tags = found.where(F.col("kind").isin("start", "end")).withColumn("__after", F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    tags = tags.withColumn("depth", F.when(F.col("kind") == "start", F.col("__after")).otherwise(F.col("__after") + 1)).withColumn("name", X.tag_name("raw"))
    before = F.lag("name").over(Window.partitionBy("doc_id", "depth").orderBy("seq"))
    bad = tags.withColumn("__open", before).where((F.col("kind") == "end") & (F.col("__open").isNull() | (F.col("__open") != F.col("name"))))
    return bad.groupBy("doc_id").agg(F.min("seq").alias("seq")).withColumn("error_code", F.lit(7))


def verdicts(*rules: DataFrame) -> DataFrame:
    """Of rule relations (doc_id, seq, error_code), each document's first: what comes from there on is not delivered."""
    out = rules[0].select("doc_id", "seq", "error_code")
    for r in rules[1:]:
        out = out.unionByName(r.select("doc_id", "seq", "error_code"))
    return out.groupBy("doc_id").agg(F.min(F.struct("seq", "error_code")).alias("first")).select("doc_id", F.col("first.seq").alias("seq"), F.col("first.error_code").alias("error_code"))


def before_error(found: DataFrame, firsts: DataFrame) -> DataFrame:
    """The tokens or events of each document that come before its first error."""
    first = firsts.select("doc_id", F.col("seq").alias("__first"))
    return found.join(first, "doc_id", "left").where("__first IS NULL OR seq < __first").drop("__first")


def paths(found: DataFrame) -> DataFrame:
    """elements() or element events (doc_id, seq, depth, name) with path, the names from the root.

    Each element asks, under every depth above its own, for the last name there: as many rows as a
    path has names, and no list that grows with the document.
    """
    asked = found.select("doc_id", "seq", "depth", "name", F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("k"))
    before = Window.partitionBy("doc_id", "k").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    last = asked.select("doc_id", "seq", "k", F.last(F.when(F.col("k") == F.col("depth"), F.col("name")), ignorenulls=True).over(before).alias("n"))
    whole = last.groupBy("doc_id", "seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda s: s["n"]).alias("names"))
    return found.join(whole, ["doc_id", "seq"]).withColumn("path", F.concat(F.lit("/"), F.array_join("names", "/"))).drop("names")


def amplification(frames: DataFrame) -> DataFrame:
    """(doc_id, seq, bytes, inside) of byte spans in order, with running direct and indirect sums and the factor."""
    order = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    direct, indirect = (F.sum(F.when(F.col("inside") == flag, F.col("bytes")).otherwise(0)).over(order) for flag in (False, True))
    out = frames.withColumn("direct", direct).withColumn("indirect", indirect)
    return out.withColumn("factor", X.amplification("direct", "indirect"))
