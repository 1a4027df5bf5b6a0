"""Connectors to a wiki's and a knowledge base's web interface.

fetch(url parameters) -> decoded JSON is a parameter, so tests and offline runs give a table's
rows; the default uses the standard library. Terms are deduplicated before they are asked.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein import schemas
from skein.functions.html import infobox, parse, sections

Fetch = Callable[[dict], dict]


def http_fetch(base: str, user_agent: str = "skein/1.0", timeout: float = 30.0) -> Fetch:
    def fetch(params: dict) -> dict:
        url = base + "?" + urllib.parse.urlencode(params | {"format": "json"})
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": user_agent}), timeout=timeout) as r:
            return json.load(r)

    return fetch


#: What a request may fail with; other exceptions are faults of the program and aren't caught.
FAILURES = (OSError, TimeoutError, json.JSONDecodeError)


class Politely:
    """A fetch with an interval between requests, further tries, and counts of requests and failures.

    Each worker has its own; a request that fails to the end gives an empty answer and is counted.
    """

    def __init__(self, fetch: Fetch, interval: float = 0.0, tries: int = 3, sleep: Callable[[float], None] = time.sleep):
        self.fetch, self.interval, self.tries, self.sleep = fetch, interval, tries, sleep
        self.requests = self.failures = 0

    def __call__(self, params: dict) -> dict:
        for k in range(self.tries):
            if self.requests and self.interval:
                self.sleep(self.interval * 2**k)
            self.requests += 1
            try:
                return self.fetch(params)
            except FAILURES:
                continue
        self.failures += 1
        return {}


def _politely(fetch: Fetch, interval: float = 0.0, tries: int = 3) -> Politely:
    return fetch if isinstance(fetch, Politely) else Politely(fetch, interval, tries)


def _first_page(got: dict) -> dict:
    return next(iter(got.get("query", {}).get("pages", {}).values()), {})


def page_html(fetch: Fetch, title: str) -> str | None:
    return _politely(fetch)({"action": "parse", "page": title, "prop": "text", "redirects": 1}).get("parse", {}).get("text", {}).get("*")


def page_summary(fetch: Fetch, title: str) -> str:
    return _first_page(_politely(fetch)({"action": "query", "prop": "extracts", "exintro": 1, "explaintext": 1, "titles": title, "redirects": 1})).get("extract") or ""


def page_categories(fetch: Fetch, title: str) -> list[str]:
    got = _first_page(_politely(fetch)({"action": "query", "prop": "categories", "titles": title, "cllimit": 50, "clshow": "!hidden"}))
    return [c["title"].removeprefix("Category:") for c in got.get("categories", [])]


def page_outlinks(fetch: Fetch, title: str) -> list[str]:
    """All pages of links; what came before a failure stays."""
    out: list[str] = []
    more: dict = {}
    while True:
        got = _politely(fetch)({"action": "query", "prop": "links", "titles": title, "plnamespace": 0, "pllimit": 500} | more)
        out += [x["title"] for x in _first_page(got).get("links", [])]
        if "continue" not in got:
            return out
        more = got["continue"]


def fetch_pages(titles: DataFrame, fetch: Fetch, base_url: str = "https://en.wikipedia.org/wiki/", interval: float = 0.0, tries: int = 3) -> DataFrame:
    """Raw pages of titles (title, crawl_depth), and failures, the requests that failed to the end.

    A title without a page gives a row without url, so that it is counted and not asked again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = Politely(fetch, interval, tries)
        for b in batches:
            rows = []
            for title, depth in zip(b["title"], b["crawl_depth"], strict=True):
                before = ask.failures
                html = page_html(ask, title)
                if html is None:
                    rows.append((title, None, None, None, None, None, None, depth, ask.failures - before))
                    continue
                tree = parse(html)
                rest = page_summary(ask, title), sections(tree), infobox(tree), page_categories(ask, title), page_outlinks(ask, title)
                rows.append((title, base_url + title.replace(" ", "_"), *rest, depth, ask.failures - before))
            yield pd.DataFrame(rows, columns=["title", "url", "summary", "sections", "infobox", "categories", "outlinks", "crawl_depth", "failures"])

    return titles.select("title", "crawl_depth").distinct().mapInPandas(run, schemas.RAW_PAGE + ", failures int")


def found_pages(fetched: DataFrame) -> DataFrame:
    return fetched.where(F.col("url").isNotNull()).drop("failures")


def search_terms(terms: DataFrame, fetch: Fetch, limit: int = 5, language: str = "en", interval: float = 0.0) -> DataFrame:
    """mention, rank, id, label, description: the first hits of each distinct mention."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = Politely(fetch, interval)
        for b in batches:
            rows = []
            for m in b["mention"]:
                hits = ask({"action": "wbsearchentities", "search": m, "language": language, "limit": limit}).get("search", [])
                rows += [(m, k, h.get("id"), h.get("label"), h.get("description")) for k, h in enumerate(hits[:limit])]
            yield pd.DataFrame(rows, columns=["mention", "rank", "id", "label", "description"])

    return terms.select("mention").distinct().mapInPandas(run, "mention string, rank int, id string, label string, description string")


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, pos, title: the links of stored pages, in order, as titles."""
    hrefs = F.regexp_extract_all(F.col("html"), F.lit('href="/([^"]+)"'), F.lit(1))
    return pages.select("page_id", F.posexplode(hrefs).alias("pos", "title"))


def page_titles(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
