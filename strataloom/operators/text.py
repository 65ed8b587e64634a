"""Assembly of texts: sections, file chunks, contexts, numbered names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from strataloom.functions.windows import numbered


# Titles of a text without headings and of what precedes the first one; what begins a section.
WHOLE, PREAMBLE = "README", "머리말"
HEADING = r"^\s*##? \s*\S"


def _titled(title: Column, section: Column, by: WindowSpec) -> Column:
    """The heading of a section; of the first without one, whether others follow decides."""
    return F.coalesce(title, F.when(F.max(section).over(by) > 0, F.lit(PREAMBLE)).otherwise(F.lit(WHOLE)))


def markdown_sections(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, section, title, start_line, end_line of Markdown texts.

    Headings of level 1 and 2 outside code fences begin a section, indented ones too; what precedes the
    first is a section of its own, blank ones are dropped. Windows run within one document.
    """
    lines = documents.where(F.length(text) > 0).select(key, F.posexplode(F.split(text, "\r?\n")).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos")
    fences = F.sum(F.when(F.col("line").rlike(r"^\s*```"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = lines.withColumn("fences", fences).withColumn("head", (F.col("fences") % 2 == 0) & F.col("line").rlike(HEADING))
    cut = marked.withColumn("section", F.sum(F.col("head").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sections = cut.groupBy(key, "section").agg(
        F.max(F.when(F.col("head"), F.trim(F.regexp_replace("line", r"^\s*#+\s*", "")))).alias("title"), (F.min("pos") + 1).cast("bigint").alias("start_line"), (F.max("pos") + 1).cast("bigint").alias("end_line"),
        F.max((F.length(F.trim("line")) > 0).cast("int")).alias("filled"),
    )
    titled = sections.withColumn("title", _titled(F.col("title"), F.col("section"), Window.partitionBy(key)))
    return titled.where("filled = 1").select(key, "section", "title", "start_line", "end_line")


def section_keywords(documents: DataFrame, key: str = "doc_id", text: str = "text", budget: int = 200) -> DataFrame:
    """key and keywords: the first prose lines of a text, until `budget` characters are reached, cut to them."""
    lines = documents.where(F.length(text) > 0).select(key, F.posexplode(F.split(text, "\r?\n")).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos")
    fences = F.sum(F.when(F.col("line").rlike(r"^\s*```"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    prose = lines.withColumn("fences", fences).where(r"fences % 2 = 0").where(~F.col("line").rlike(r"^\s*(?:```|#|!\[|\[!\[)"))
    plain = prose.withColumn("line", F.trim(F.regexp_replace("line", r"[*_`>|-]+", " "))).where("line <> ''")
    before = F.coalesce(F.sum(F.length("line")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = plain.withColumn("before", before).where(F.col("before") < budget)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return kept.groupBy(key).agg(F.substring(F.array_join(F.transform(ordered, lambda x: x["line"]), " "), 1, budget).alias("keywords"))


# Marks of lines that tell the state of a project only.
STATUS_MARKS = ("🚧", "⚠️", "🏗", "WIP", "Work in progress", "개발 중", "작업 중")


def keywords_by_section(documents: DataFrame, key: str = "doc_id", text: str = "text", budget: int = 200) -> DataFrame:
    """key, section, title, keywords, start_line and end_line of each section of `markdown_sections`.

    Keywords are the section's lines outside code fences without markup, sub-headings among them,
    until `budget` characters are reached, cut to them. The title's echo before the first other line,
    badges and short status lines are left out; a section of nothing else has an empty text.
    """
    lines = documents.where(F.length(text) > 0).select(key, F.posexplode(F.split(text, "\r?\n")).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos")
    fence = F.col("line").rlike(r"^\s*```")
    fences = F.sum(F.when(fence, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    bare = strip(F.regexp_replace(strip(F.col("line")), r"^#+", ""))
    plain = strip(F.replace(F.replace(F.regexp_replace(bare, r"^[-*>+ ]+", ""), F.lit("|"), F.lit(" ")), F.lit("**"), F.lit("")))
    # As markdown_sections numbers them; one shuffle by `key` serves all windows.
    marked = lines.withColumn("prose", (fences % 2 == 0)).withColumn("head", F.col("prose") & F.col("line").rlike(HEADING))
    cut = marked.withColumn("section", F.sum(F.col("head").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    inside = Window.partitionBy(key, "section").orderBy("pos")
    title = F.max(F.when(F.col("head"), F.trim(F.regexp_replace("line", r"^\s*#+\s*", "")))).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    named = cut.withColumns({"title": title, "filled": F.length(F.trim("line")) > 0, "prose": F.col("prose") & ~fence}).withColumn("line", plain)
    status = (F.length("line") <= 30) & F.col("line").rlike("|".join(STATUS_MARKS))
    joined = named.withColumn("worth", F.col("prose") & ~F.col("line").rlike(r"^[-: ]*$|^\[?!\[") & ~status)
    begun = F.max(F.col("worth") & ~F.col("line").eqNullSafe(F.col("title"))).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    picked = joined.withColumn("picked", F.col("worth") & begun)
    before = F.coalesce(F.sum(F.when(F.col("picked"), F.length("line")).otherwise(0)).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = picked.withColumn("kept", F.when(F.col("picked") & (before < budget), F.struct("pos", "line")))
    ordered = F.transform(F.array_sort(F.collect_list("kept")), lambda x: x["line"])
    found = kept.groupBy(key, "section").agg(F.max("title").alias("title"), F.substring(F.array_join(ordered, " "), 1, budget).alias("keywords"), F.max("filled").alias("filled"), (F.min("pos") + 1).cast("bigint").alias("start_line"), (F.max("pos") + 1).cast("bigint").alias("end_line"))
    titled = found.withColumn("title", _titled(F.col("title"), F.col("section"), Window.partitionBy(key)))
    return titled.where("filled").drop("filled")


def occurrence_numbers(chunks: DataFrame) -> DataFrame:
    """chunk_id and numbered: the symbol, from its second occurrence in a file on with # and its number."""
    base = F.regexp_replace("symbol", r"#\d+$", "")
    number = numbered(Window.partitionBy("repo_id", "file", "base").orderBy("start_line", "chunk_id"))
    symbols = chunks.where(F.col("kind").isin("class", "method", "function")).withColumn("base", base).withColumn("number", number)
    return symbols.select("chunk_id", F.when(F.col("number") > 1, F.concat("base", F.lit("#"), F.col("number").cast("string"))).otherwise(F.col("base")).alias("numbered"))


def file_chunks(chunks: DataFrame) -> DataFrame:
    """repo_id, file, n_symbols and outline of each file: public symbols in source order, then their summaries.

    Public is what has no parent or a class of the file as parent.
    """
    members = chunks.where(F.col("kind").isin("class", "method", "function"))
    classes = members.where("kind = 'class'").select("repo_id", "file", F.col("symbol").alias("parent"), F.lit(True).alias("of_class")).distinct()
    public = members.join(classes, ["repo_id", "file", "parent"], "left").where("parent is null or of_class")
    ordered = F.array_sort(F.collect_list(F.struct("start_line", "symbol", F.coalesce("summary", F.lit("")).alias("summary"))))
    rows = public.groupBy("repo_id", "file").agg(F.count("*").alias("n_symbols"), ordered.alias("s"))
    names = F.array_join(F.transform("s", lambda x: x["symbol"]), ", ")
    summaries = F.array_join(F.filter(F.transform("s", lambda x: x["summary"]), lambda x: x != ""), " / ")
    return rows.select("repo_id", "file", "n_symbols", F.concat_ws("\n", names, F.nullif(summaries, F.lit(""))).alias("outline"))


def embedding_text(chunks: DataFrame) -> DataFrame:
    """chunk_id and the text that stands for the chunk in a vector index."""
    return chunks.select("chunk_id", F.concat_ws("\n", "file", "symbol", "kind", F.nullif("summary", F.lit("")), "code").alias("text"))


def context_block(chunks: DataFrame) -> DataFrame:
    """chunk_id and where it lies, as a reader of evidence sees it."""
    return chunks.select("chunk_id", F.format_string("%s:%d-%d %s", "file", "start_line", "end_line", "symbol").alias("location"))


def names_line(groups: DataFrame, by: list[str], name: str, shown: int = 6) -> DataFrame:
    """by and line: the first `shown` names in order, and how many more there are."""
    names = groups.select(*by, name).distinct()
    first = names.withColumn("rank", numbered(Window.partitionBy(*by).orderBy(name))).where(F.col("rank") <= shown)
    lists = first.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(name)), ", ").alias("first"))
    rows = names.groupBy(*by).agg(F.count("*").alias("n")).join(lists, by)
    more = F.when(F.col("n") > shown, F.concat(F.lit(" and "), (F.col("n") - shown).cast("string"), F.lit(" more"))).otherwise("")
    return rows.select(*by, F.concat("first", more).alias("line"))
