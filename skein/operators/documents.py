"""From pages to clean documents, sentences and their spans."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.batches import by_rows
from skein.functions.html import page_parts
from skein.functions.text import clean_text, is_ascii, split_sentences


def assemble_page(df: DataFrame, base_url: str = "https://en.wikipedia.org/wiki/") -> DataFrame:
    """Raw pages of title, summary and html columns."""
    out = df.withColumn("_parts", page_parts("html"))
    return out.withColumns({"url": F.concat(F.lit(base_url), F.replace("title", F.lit(" "), F.lit("_"))), "sections": F.col("_parts.sections"), "infobox": F.col("_parts.infobox")}).drop("_parts")


def clean_documents(raw: DataFrame) -> DataFrame:
    """Processed documents: clean texts, sentences, defaults; sections without text go."""
    summary = clean_text(F.coalesce("summary", F.lit("")))
    section = lambda s: F.struct(F.coalesce(s["heading"], F.lit("")).alias("heading"), s["clean"].alias("text"), split_sentences(s["clean"]).alias("sentences"))
    # A pandas UDF takes columns, not lambda variables: texts are normalised as one array's elements.
    out = raw.withColumn("_texts", F.transform(F.coalesce("sections", F.array().cast("array<struct<heading:string,text:string>>")), lambda s: F.coalesce(s["text"], F.lit(""))))
    out = out.withColumn("_texts", nfkc_all("_texts"))
    cleaned = F.transform("_texts", lambda t: clean_text(t, normalize=False))
    pairs = F.zip_with("sections", cleaned, lambda s, t: F.struct(s["heading"].alias("heading"), t.alias("clean")))
    return out.select(
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("url", F.lit("")).alias("url"),
        summary.alias("summary"),
        split_sentences(summary).alias("summary_sentences"),
        F.transform(F.filter(F.coalesce(pairs, F.array().cast("array<struct<heading:string,clean:string>>")), lambda s: s["clean"] != ""), section).alias("sections"),
        F.coalesce("infobox", F.create_map().cast("map<string,string>")).alias("infobox"),
        F.coalesce("categories", F.array().cast("array<string>")).alias("categories"),
        F.coalesce("outlinks", F.array().cast("array<string>")).alias("outlinks"),
        F.coalesce("crawl_depth", F.lit(-1)).alias("crawl_depth"),
    )


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc_all(s: pd.Series) -> pd.Series:
    return s.map(lambda a: None if a is None else [unicodedata.normalize("NFKC", x) for x in a])


def nfkc_all(texts: str) -> Column:
    """NFKC of an array of texts; those of ASCII alone don't leave the JVM."""
    return F.coalesce(_nfkc_all(F.when(F.exists(texts, lambda t: ~is_ascii(t)), F.col(texts))), F.col(texts))


def full_text(summary: Column, sections: Column, more: Column | None = None) -> Column:
    """The one text that mentions and sentence spans are both places in. more: further texts, as an array."""
    parts = [F.array(F.coalesce(summary, F.lit(""))), F.filter(F.transform(sections, lambda s: s["text"]), lambda t: F.coalesce(t, F.lit("")) != "")]
    return F.concat_ws("\n\n", F.concat(*parts, *([more] if more is not None else [])))


def text_of(docs: DataFrame) -> Column:
    """The text of documents that may name their parts otherwise.

    The summary; the text or else the content of each section, of the list sections or else body;
    then text and content of the document itself; joined by blank lines. Without any of these, all
    string columns; without those, the row as JSON.
    """
    fields = {f.name: f.dataType for f in docs.schema.fields}
    strings = [c for c, t in fields.items() if isinstance(t, T.StringType)]
    own = lambda c: F.array(F.col(c)) if c in strings else F.array().cast("array<string>")

    def texts(name: str) -> Column | None:
        kind = fields.get(name)
        if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)):
            return None
        have = [f for f in ("text", "content") if f in kind.elementType.fieldNames()]
        if not have:
            return None
        return F.filter(F.transform(F.col(name), lambda s: F.coalesce(*[F.nullif(s[f], F.lit("")) for f in have])), lambda t: t.isNotNull())

    lists = [t for t in map(texts, ("sections", "body")) if t is not None]
    chosen = [F.coalesce(*[F.when(F.size(F.col(n)) > 0, t) for n, t in zip([n for n in ("sections", "body") if texts(n) is not None], lists, strict=True)], F.array().cast("array<string>"))] if lists else []
    parts = F.filter(F.concat(own("summary"), *chosen, own("text"), own("content")), lambda t: t.isNotNull())
    every = F.filter(F.array(*[F.col(c) for c in strings]), lambda t: t.isNotNull()) if strings else F.array().cast("array<string>")
    return F.when(F.size(parts) > 0, F.concat_ws("\n\n", parts)).when(F.size(every) > 0, F.concat_ws("\n\n", every)).otherwise(F.to_json(F.struct(*docs.columns)))


def sentence_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, sent_idx, sentence of plain texts."""
    return docs.select(key, F.posexplode(split_sentences(F.col(text))).alias("sent_idx", "sentence"))


def document_sentences(docs: DataFrame) -> DataFrame:
    """title, section, sent_idx, sentence of processed documents; numbers begin anew in each section."""
    summary = F.struct(F.lit("summary").alias("section"), F.col("summary_sentences").alias("sentences"))
    parts = F.concat(F.array(summary), F.transform("sections", lambda s: F.struct(s["heading"].alias("section"), s["sentences"].alias("sentences"))))
    one = docs.select("title", F.posexplode(parts).alias("part", "s"))
    return one.select("title", "part", F.col("s.section").alias("section"), F.posexplode("s.sentences").alias("sent_idx", "sentence"))


def sentence_spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, sent_idx, sentence, sent_start, sent_end, by a sequential Arrow pass over each text, in bounded batches."""

    def run(columns):
        for k, t, ss in zip(*columns, strict=True):
            at = 0
            for i, s in enumerate(ss if ss is not None else ()):
                found = t.find(s, at)
                start = found if found >= 0 else at
                at = start + len(s)
                yield k, i, s, start, at

    thin = docs.select(key, F.col(text).alias("_t"), split_sentences(F.col(text)).alias("_s"))
    return thin.transform(by_rows(lambda: run, f"{key} {docs.schema[key].dataType.simpleString()}, sent_idx int, sentence string, sent_start int, sent_end int"))
