"""Settings: word lists, tables and limits. Each is a parameter; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

# Infobox keys and the relations they stand for.
RELATION_MAPPING = {
    "alma_mater": "educated_at",
    "born": "birth_place",
    "died": "death_place",
    "cause_of_death": "cause_of_death",
    "known_for": "known_for",
    "awards": "award_received",
    "fields": "field_of_work",
    "institutions": "worked_at",
    "thesis": "authored",
    "doctoral_advisor": "doctoral_advisor",
    "doctoral_students": "doctoral_student",
    "author": "authored_by",
    "language": "language",
    "subject": "subject",
    "genre": "genre",
    "published": "publication_date",
    "publication_place": "publication_place",
    "abbreviation": "abbreviation",
    "discipline": "discipline",
    "publisher": "published_by",
}

# Names that stand for one entity.
ALIASES = {
    "turing": "Alan Turing",
    "alan turing": "Alan Turing",
    "alan mathison turing": "Alan Turing",
}

# Relations whose value is one entity, and relations whose value may list several.
WHOLE_RELATIONS = ("birth_place", "death_place", "cause_of_death", "publication_date", "genre", "language")
LISTED_RELATIONS = ("doctoral_student", "doctoral_advisor", "educated_at", "worked_at", "known_for", "field_of_work")

# Entity types that make no candidate pair.
LOW_VALUE_TYPES = ("CARDINAL", "ORDINAL", "QUANTITY", "MONEY", "PERCENT")

# Which source of a triple goes before another.
SOURCE_PRIORITY = {"infobox": 3, "silver": 2, "rebel": 1}

# What page titles a crawl follows.
SEED_KEYWORDS = (
    "turing", "computation", "computable", "cryptography", "cryptanalysis", "enigma", "bombe", "bletchley", "artificial intelligence", "church",
    "manchester", "cambridge", "princeton", "halting problem", "turing machine", "turing test", "computer science", "algorithm", "logic", "morphogenesis",
)
EXCLUDED_PREFIXES = ("Wikipedia:", "File:", "Template:", "Category:", "Help:", "Portal:", "Draft:", "Module:", "MediaWiki:", "Talk:", "User:")
EXCLUDED_SUFFIXES = ("(disambiguation)",)


@dataclass(frozen=True)
class Settings:
    """What a settings file may change."""

    seed_page: str = "Alan Turing"
    max_depth: int = 2
    max_pages: int = 80
    request_interval: float = 1.0
    language: str = "en"
    user_agent: str = "skein/1.0"
    seed_keywords: tuple[str, ...] = SEED_KEYWORDS
    excluded_prefixes: tuple[str, ...] = EXCLUDED_PREFIXES
    excluded_suffixes: tuple[str, ...] = EXCLUDED_SUFFIXES
    processed_data: str = "data/processed"
    paths: dict = field(default_factory=dict)


def load_settings(path: str | Path) -> Settings:
    """Settings of a YAML file; defaults where it is missing, broken or silent."""
    try:
        import yaml

        raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
        crawler, paths = raw.get("crawler") or {}, raw.get("paths") or {}
        relevance = crawler.get("relevance") or {}
        known = {k: crawler[k] for k in ("seed_page", "max_depth", "max_pages", "request_interval", "language", "user_agent") if k in crawler}
        lists = {k: tuple(relevance[k]) for k in ("seed_keywords", "excluded_prefixes", "excluded_suffixes") if k in relevance}
        return Settings(**known, **lists, processed_data=paths.get("processed_data", "data/processed"), paths=dict(paths))
    except Exception:  # any fault of the file means the defaults
        return Settings()


def load_mapping(path: str | Path) -> dict[str, str]:
    """A YAML file of string pairs, such as the relation mapping."""
    import yaml

    return {str(k): str(v) for k, v in (yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}).items()}
