"""From page text to one table of chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions import fixed
from lexspark.functions import text as tx
from lexspark.operators.lookups import first_row
from lexspark.operators.windows import batch_number, carry_forward, global_row_number

CHUNK_COLUMNS = ["chunk_id", "section_number", "title", "chunk_text", "source_law", "chapter", "content_type"]
_PAGES_PER_GROUP = 256


# --- raw documents -----------------------------------------------------------------------------
def clean_documents(documents: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Squeeze whitespace, note the full length, keep texts longer than 100 characters.

    ``max_chars`` cuts the stored text; by default it stays whole.
    """
    cleaned = tx.once(documents, "filename", text=tx.squeeze(F.col("text")))
    return (
        cleaned.withColumn("char_count", F.length("text").cast("bigint"))
        .where(F.col("char_count") > fixed.MIN_DOCUMENT_CHARS)
        .withColumn("text", tx.cut(F.col("text"), max_chars))
    )


def join_pages(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """(filename, page_no, text) to one cleaned row per file, as ``clean_documents`` would give it.

    Pages are squeezed first and joined in two steps, groups of pages and then files, so that a
    file with very many pages is not gathered by one task in one go. The length is a sum.
    """
    squeezed = tx.once(pages, "filename", "page_no", text=tx.squeeze(F.col("text"))).where(F.col("text") != "") \
        .withColumn("_group", F.floor(F.col("page_no") / _PAGES_PER_GROUP))

    def joined(order: str):
        ordered = F.array_sort(F.collect_list(F.struct(order, "text")))
        return tx.cut(F.array_join(F.transform(ordered, lambda p: p["text"]), " "), max_chars)

    groups = squeezed.groupBy("filename", "_group").agg(
        joined("page_no").alias("text"), F.sum(F.length("text") + 1).alias("_chars"))
    files = groups.groupBy("filename").agg(joined("_group").alias("text"),
                                           (F.sum("_chars") - 1).cast("bigint").alias("char_count"))
    return files.where(F.col("char_count") > fixed.MIN_DOCUMENT_CHARS)


def ingest_documents(pages: DataFrame, listing: DataFrame | None = None,
                     size: int = fixed.FILES_PER_BATCH, max_chars: int | None = None) -> DataFrame:
    """The raw text table: cleaned files with the number of the 50-file batch they came in."""
    names = (pages if listing is None else listing).select("filename").distinct()
    batches = batch_number(names, ["filename"], size)
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return join_pages(pages, max_chars).join(batches, "filename").withColumn("extracted_at", stamp)


# --- sections ----------------------------------------------------------------------------------
def usable_pages(pages: DataFrame) -> DataFrame:
    """Pages with at least 50 characters; others do not even lend their chapter heading."""
    return pages.where(F.length(tx.strip(F.col("text"))) >= fixed.MIN_PAGE_CHARS)


def with_chapters(pages: DataFrame) -> DataFrame:
    """First heading on the page, else the last one before it in the document, else UNKNOWN."""
    headed = usable_pages(pages).withColumn("chapter", tx.chapter_heading(F.col("text")))
    return carry_forward(headed, "doc_id", "page_no", "chapter", fixed.UNKNOWN_CHAPTER)


def paragraphs(pages: DataFrame) -> DataFrame:
    """One row per paragraph of at least 30 characters, split on blank lines and stripped."""
    others = [c for c in pages.columns if c != "text"]
    parts = F.transform(F.split("text", fixed.PARAGRAPH_BREAK), tx.strip)
    split = usable_pages(pages).select(*others, F.posexplode(parts).alias("paragraph_no", "paragraph"))
    return split.where(F.length("paragraph") >= fixed.MIN_PARAGRAPH_CHARS)


def extract_sections(pages: DataFrame, source_law: str, text_chars: int | None = None,
                     title_chars: int | None = None) -> DataFrame:
    """(doc_id, page_no, text) to numbered sections, at most one per paragraph.

    Keywords come from the whole text; the limits cut the stored columns only, by default nothing.
    """
    para = F.col("paragraph")
    by_statute, by_number = fixed.STATUTORY_SECTION, fixed.SIMPLE_SECTION
    found = tx.once(
        paragraphs(with_chapters(pages)), "doc_id", "page_no", "paragraph_no", "chapter", "paragraph",
        **{f"_full_{g}": tx.extract(para, by_statute, g) for g in (1, 2, 3)},
        **{f"_bare_{g}": tx.extract(para, by_number, g) for g in (0, 1, 2)},
    ).where(F.coalesce("_full_1", "_bare_1").isNotNull())

    is_full = F.col("_full_1").isNotNull()
    rest = tx.strip(F.substring("paragraph", F.length("_bare_0") + 1, F.length("paragraph")))
    body = F.when(is_full, tx.strip(F.col("_full_3"))).otherwise(
        F.when(F.length(rest) < fixed.MIN_BODY_CHARS, para).otherwise(rest))
    title = tx.strip(F.when(is_full, F.col("_full_2")).otherwise(F.col("_bare_2")))
    sections = found.select(
        "doc_id", "page_no", "paragraph_no",
        F.coalesce("_full_1", "_bare_1").alias("section_number"),
        tx.single_spaces(title).alias("title"),
        tx.single_spaces(body).alias("full_text"),
        "chapter", F.lit(source_law).alias("source_law"),
    )
    named = sections.select(
        "*", tx.keywords(F.col("title"), F.col("full_text")).alias("keywords"),
        F.length("full_text").cast("bigint").alias("char_count"),
        F.col("page_no").cast("bigint").alias("page_number"),
    ).drop("page_no")
    return named.withColumns({"title": tx.cut(F.col("title"), title_chars), "full_text": tx.cut(F.col("full_text"), text_chars)})


# --- schemes and the section map ---------------------------------------------------------------
def scheme_table(raw: DataFrame, text_chars: int | None = None) -> DataFrame:
    """Raw scheme texts to structured rows; a field that is not found is NULL."""
    text = F.col("text")
    return raw.where(F.col("char_count") > fixed.MIN_DOCUMENT_CHARS).select(
        F.col("filename").alias("source_file"),
        tx.extract(text, fixed.SCHEME_NAME).alias("scheme_name"),
        tx.extract(text, fixed.MINISTRY).alias("ministry"),
        tx.extract(text, fixed.BENEFICIARY).alias("beneficiary_type"),
        tx.extract(text, fixed.STATE).alias("state"),
        tx.amount(text).alias("income_limit_inr"),
        tx.cut(text, text_chars).alias("full_text"),
        "char_count",
    )


def mapping_table(pairs: DataFrame) -> DataFrame:
    """Old/new section pairs with a sentence on the change and one on its effect."""
    return pairs.select(
        "ipc_section", "ipc_title", "bns_section", "bns_title", "change_type",
        tx.change_detail(F.col("change_type"), F.col("ipc_section"), F.col("bns_section")).alias("change_detail"),
        tx.change_impact(F.col("change_type")).alias("impact_for_citizen"),
    )


def classify_schemes(schemes: DataFrame, classes: Sequence[tuple[str, Sequence[str]]] | None = None) -> DataFrame:
    """One beneficiary class per scheme by the first class word found in name or text."""
    text = F.concat_ws(" ", "scheme_name", "full_text")
    label = tx.ladder(text, classes or fixed.BENEFICIARY_CLASSES, fixed.DEFAULT_CLASS)
    return schemes.withColumn("category", label)


def extract_info(schemes: DataFrame, documents_per_scheme: int | None = None) -> DataFrame:
    """Beneficiary, income limit and required documents (all, or the first few) as one struct."""
    text = F.col("full_text")
    documents = F.array_distinct(F.regexp_extract_all(text, F.lit(fixed.DOCUMENT_NAMES), F.lit(1)))
    if documents_per_scheme is not None:
        documents = F.slice(documents, 1, documents_per_scheme)
    return schemes.withColumn("extracted_info", F.struct(
        tx.extract(text, fixed.BENEFICIARY).alias("beneficiary"),
        tx.amount(text).alias("income_limit"),
        documents.alias("documents"),
    ))


# --- chunks ------------------------------------------------------------------------------------
def section_chunks(sections: DataFrame, prefix: str, text_chars: int | None = None) -> DataFrame:
    """Sections in the chunk shape, one per chunk id: the longest text, then the lowest page."""
    shaped = sections.select(
        tx.prefixed_id(prefix, F.col("section_number")).alias("chunk_id"),
        "section_number", "title",
        F.concat_ws(" ", "title", tx.cut(F.col("full_text"), text_chars)).alias("chunk_text"),
        "source_law", "chapter", F.lit("legal_section").alias("content_type"),
        (-F.length("full_text")).alias("_shortness"), F.col("page_number").alias("_page"),
    )
    return first_row(shaped, "chunk_id", ["_shortness", "_page", "title", "chunk_text"]).select(*CHUNK_COLUMNS)


def scheme_chunks(schemes: DataFrame, source_law: str = "schemes", text_chars: int | None = None) -> DataFrame:
    """Named schemes in the chunk shape, numbered 1..n in order of their file."""
    named = schemes.where(F.col("scheme_name").isNotNull()).select(
        "source_file", "scheme_name", "ministry", "beneficiary_type", "state",
        tx.cut(F.col("full_text"), text_chars).alias("full_text"))
    numbered = global_row_number(named, ["source_file", "scheme_name"], name="_number")
    return numbered.select(
        tx.prefixed_id("scheme_", F.col("_number")).alias("chunk_id"),
        F.lit("").alias("section_number"),
        F.col("scheme_name").alias("title"),
        F.concat_ws(" ", "scheme_name", "ministry", "beneficiary_type", "state", "full_text").alias("chunk_text"),
        F.lit(source_law).alias("source_law"),
        F.col("ministry").alias("chapter"),
        F.lit("government_scheme").alias("content_type"),
    )


def unified_chunks(statutes: dict[str, DataFrame], schemes: DataFrame) -> DataFrame:
    """All sources in one table; ``statutes`` gives the sections for each chunk id prefix."""
    chunks = scheme_chunks(schemes)
    for prefix, sections in statutes.items():
        chunks = chunks.unionByName(section_chunks(sections, prefix))
    return chunks
