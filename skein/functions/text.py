"""Column functions on text. White space and word characters are Unicode's throughout."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.config import ALIASES, LISTED_RELATIONS, WHOLE_RELATIONS


def is_ascii(c: Column) -> Column:
    return ~c.rlike(r"[^\x00-\x7f]")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    """NFKC; texts of ASCII alone, which it doesn't change, don't leave the JVM."""
    return F.coalesce(_nfkc(F.when(~is_ascii(c), c)), c)


#: Stands for the dotless i while cases change; no text has it.
_HELD = "\ue000"


def casefold(c: Column) -> Column:
    """Full case folding by case mappings, which differ from it on Cherokee and a few rare signs alone.

    Upper case spells out what folding spells out; the dotless i and the final sigma go their own way.
    Spark's optimizer drops a case change right within another, so the dotless i is held and given back between them.
    """
    upper = F.upper(F.translate(F.lower(c), "\u0131", _HELD))
    return F.translate(F.lower(F.translate(upper, _HELD, "\u0131")), "\u03c2", "\u03c3")


def search_text(text: str | None) -> str:
    """search_norm of a text that the driver has."""
    return " ".join((text or "").split()).casefold()


def clean_text(c: Column, normalize: bool = True) -> Column:
    """NFKC; without reference marks and tags; runs of blanks, and of three or more newlines, cut; stripped."""
    c = nfkc(c) if normalize else c
    c = F.regexp_replace(c, r"\[(?:\d+|note \d+|[a-z])\]", "")
    c = F.regexp_replace(c, r"<[^>]+>", "")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(c)


def split_sentences(c: Column) -> Column:
    """Sentences end at a full stop, exclamation or question mark before white space."""
    return F.filter(F.transform(F.split(c, r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")


def normalize_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(F.replace(c, F.lit(" "), F.lit(" ")))), r"(?U)\s+", "_")


def match_norm(c: Column) -> Column:
    """Lower case a-z, digits and single spaces; stripped before the deletion, not after."""
    return F.regexp_replace(F.regexp_replace(strip(F.lower(c)), r"[^a-z0-9\s]", ""), r"\s+", " ")


def search_norm(c: Column) -> Column:
    """Stripped, single spaces, cases folded."""
    c = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"(?U)\s+", " ")
    return F.when(is_ascii(c), F.lower(c)).otherwise(casefold(c))


def lowered(c: Column) -> Column:
    """Single spaces for ASCII white space, without spaces at the ends, in lower case letter by letter, as in SQL; null stays.

    Spark's lower alone would give a sigma at a word's end its own form, and the dotted I two code points.
    """
    c = F.regexp_replace(F.regexp_replace(c, r"[\t\n\f\r ]+", " "), r"^\p{Zs}+|\p{Zs}+\z", "")
    return F.lower(F.translate(c, "\u0130\u03a3", "i\u03c3"))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(search_norm(c), r"(?U)[^\w]+"), lambda t: t != ""))


def alias_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", ""))


def apply_aliases(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """The canonical name of an alias, else the text; null becomes empty."""
    pairs = ALIASES if aliases is None else aliases
    if not pairs:
        return F.coalesce(c, F.lit(""))
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.element_at(table, alias_key(c)), c, F.lit(""))


def split_value(value: Column, relation: Column) -> Column:
    """The entities of an infobox value.

    Some relations keep their value whole, without remarks in brackets, and places without names
    and dates. Others are cut at semicolons and newlines, some of those also at two blanks or more.
    """
    plain = strip(F.regexp_replace(value, r"\([^)]*\)", ""))
    edge = r"^[ ,]+|[ ,]+$"
    day, iso = r"(?U)\d{1,2} \w+ \d{4}", r"\d{4}-\d{2}-\d{2}"
    born = F.regexp_replace(plain, r"^[A-Z][a-z]+ [A-Z][a-z]+ [A-Z][a-z]+\s*", "")
    born = F.regexp_replace(F.regexp_replace(F.regexp_replace(born, iso, ""), day, ""), edge, "")
    died = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, day, ""), iso, ""), r"aged \d+", "")
    died = F.regexp_replace(died, edge, "")
    whole = F.when(relation == "birth_place", born).when(relation == "death_place", died).otherwise(plain)
    parts = F.filter(F.transform(F.split(value, r"[;\n]"), lambda p: strip(F.regexp_replace(p, r"\([^)]*\)", ""))), lambda p: p != "")
    finer = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) > 20, F.filter(F.transform(F.split(p, r"(?U)\s{2,}"), strip), lambda s: s != "")).otherwise(F.array(p))))
    return (
        F.when(relation.isin(*WHOLE_RELATIONS), F.filter(F.array(whole), lambda w: F.length(w) > 1))
        .when(relation.isin(*LISTED_RELATIONS), finer)
        .otherwise(parts)
    )


def file_name_of_title(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, r'[<>:"/\\|?*]', "_"), 1, 200)


def title_of_file_name(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def strip_special_tokens(c: Column) -> Column:
    for t in ("<s>", "</s>", "<pad>"):
        c = F.replace(c, F.lit(t), F.lit(""))
    return strip(c)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in double precision; null where one is null or zero."""
    d = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = F.aggregate(F.zip_with(d(a), d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda x: F.sqrt(F.aggregate(d(x), F.lit(0.0), lambda s, v: s + v * v))
    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


def link_score(mention: Column, label: Column, description: Column) -> Column:
    """1 for an equal label, and 0.1 for each word of the mention in the description."""
    words = F.filter(F.split(F.lower(mention), r"(?U)\s+"), lambda w: w != "")
    hits = F.size(F.filter(words, lambda w: F.contains(F.lower(F.coalesce(description, F.lit(""))), w)))
    return F.when(F.lower(label) == F.lower(mention), F.lit(1.0)).otherwise(F.lit(0.0)) + hits * F.lit(0.1)


# Colours of node types, and of relations by number.
TYPE_COLORS = {
    "PERSON": "#e74c3c",
    "ORG": "#3498db",
    "GPE": "#2ecc71",
    "LOC": "#27ae60",
    "DATE": "#f39c12",
    "EVENT": "#9b59b6",
    "WORK_OF_ART": "#e67e22",
    "FAC": "#1abc9c",
    "NORP": "#95a5a6",
    "LAW": "#34495e",
    "LANGUAGE": "#16a085",
    "PRODUCT": "#d35400",
    "CONCEPT": "#8e44ad",
    "DEVICE": "#c0392b",
    "AWARD": "#f1c40f",
    "UNKNOWN": "#bdc3c7",
}
RELATION_COLORS = ("#c95b38", "#1d7f77", "#4d8a4f", "#9b4f7d", "#ae6831", "#42516f", "#d7a63c", "#7a5db8", "#3286a8", "#8e6c35", "#7b5f52", "#2f7c64")


def type_color(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in TYPE_COLORS.items() for x in kv])
    return F.coalesce(F.element_at(table, kind), F.lit(TYPE_COLORS["UNKNOWN"]))


def readable(relation: Column) -> Column:
    """A relation's name with spaces, as an encoder reads it; underscored() is the way back."""
    return F.replace(relation, F.lit("_"), F.lit(" "))


def underscored(name: Column) -> Column:
    return F.replace(name, F.lit(" "), F.lit("_"))


def relation_color_number(relation: Column) -> Column:
    """The sum of position times code point, modulo 12, over the stripped lower-case name."""
    letters = F.filter(F.split(F.lower(strip(F.when(F.coalesce(relation, F.lit("")) == "", F.lit("unknown")).otherwise(relation))), ""), lambda c: c != "")
    return F.aggregate(F.transform(letters, lambda c, i: (i + 1) * F.ascii(c)), F.lit(0), lambda s, x: s + x) % 12


def node_size(degree: Column, most: Column) -> Column:
    return F.lit(420.0) + F.lit(1900.0) * degree / F.greatest(most, F.lit(1))


def edge_width(confidence: Column) -> Column:
    return F.lit(1.4) + F.lit(1.6) * F.coalesce(confidence, F.lit(0.0))


def edge_identity(source: Column, relation: Column, target: Column) -> Column:
    return F.concat_ws("::", source, relation, target)


def tooltip(label: Column, kind: Column, qid: Column, description: Column) -> Column:
    """Escaped HTML lines of what a node has."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name), esc(c)))
    return F.concat_ws("<br>", F.concat(F.lit("<b>"), esc(label), F.lit("</b>")), line("Type: ", kind), line("QID: ", qid), line("", description))
