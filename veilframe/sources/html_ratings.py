"""Ratings of one person from pages: list items first, JSON in scripts only where there are none."""

from __future__ import annotations

import html as _html
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The class of a list item of the page, and keys of its JSON.
ITEM_CLASS = "ipc-metadata-list-summary-item"
TITLE_KEYS, RATING_KEYS = ("titleText", "originalTitleText"), ("userRating", "rating")
VOID = {"br", "img", "input", "meta", "link", "hr", "source", "wbr"}

Row = tuple[str, int | None, str, float]


class _Items(HTMLParser):
    """Collects of each list item its heading, its texts and the texts of its star marks."""

    def __init__(self):
        super().__init__()
        self.items: list[dict] = []
        self.open: list[tuple[str, str]] = []
        self.depth = None

    def handle_starttag(self, tag, attrs):
        classes = dict(attrs).get("class") or ""
        if tag == "li" and ITEM_CLASS in classes.split() and self.depth is None:
            self.depth = len(self.open)
            self.items.append({"title": "", "texts": [], "stars": []})
        if tag not in VOID:
            self.open.append((tag, classes))

    def handle_endtag(self, tag):
        while self.open:
            got, _ = self.open.pop()
            if got == tag:
                break
        if self.depth is not None and len(self.open) <= self.depth:
            self.depth = None

    def handle_data(self, data):
        text = data.strip()
        if self.depth is None or not text:
            return
        item = self.items[-1]
        item["texts"].append(text)
        if any(tag in ("h3", "h4") for tag, _ in self.open):
            item["title"] = f"{item['title']} {text}".strip()
        if any("rating-star--rating" in c or "ratingGroup--user-rating" in c for _, c in self.open):
            item["stars"].append(text)


def _number(text) -> float | None:
    found = re.search(r"\d+(?:\.\d+)?", str(text))
    return float(found[0]) if found else None


def item_rows(page: str, user: str) -> list[Row]:
    parser = _Items()
    parser.feed(page)
    rows = []
    for item in parser.items:
        title = re.sub(r"^\d+\.\s*", "", item["title"])
        stars = [x for x in map(_number, item["stars"]) if x is not None]
        years = [int(y[0]) for t in item["texts"] if t != item["title"] and (y := re.search(r"\b(?:1[89]|20)\d\d\b", t))]
        if title and stars:
            rows.append((title, years[0] if years else None, user, stars[-1]))
    return rows


def _walk(node) -> Iterator[dict]:
    todo = [node]
    while todo:
        at = todo.pop(0)
        if isinstance(at, dict):
            yield at
            todo += at.values()
        elif isinstance(at, list):
            todo += at


def _text(value):
    return value.get("text") or value.get("value") if isinstance(value, dict) else value


def json_rows(page: str, user: str) -> list[Row]:
    rows: dict[Row, None] = {}  # in order, each once
    for body in re.findall(r"<script[^>]*>(.*?)</script>", page, re.S | re.I):
        try:
            payload = json.loads(_html.unescape(body).strip())
        except ValueError:
            continue
        for node in _walk(payload):
            title = next((t for k in TITLE_KEYS if (t := _text(node.get(k)))), None)
            raw = next((node[k] for k in RATING_KEYS if node.get(k) is not None), None)
            if isinstance(raw, dict):
                raw = raw.get("value", raw.get("rating"))
            rating = _number(raw) if isinstance(raw, (int, float, str)) else None
            if not title or rating is None:
                continue
            year = node.get("releaseYear")
            year = _number(year.get("year") if isinstance(year, dict) else year) if year is not None else None
            row = (str(title), int(year) if year else None, user, rating)
            rows[row] = None
    return list(rows)


def page_rows(page: str | None, user: str) -> list[Row]:
    return (item_rows(page, user) or json_rows(page, user)) if page else []


def extract_ratings(pages: DataFrame, html_col: str = "html", user_col: str | None = None) -> DataFrame:
    """pages' other columns with title, year, user, rating: a row for each rating found."""
    kind = "array<struct<title:string,year:int,user:string,rating:double>>"

    @F.pandas_udf(kind)
    def found(page: pd.Series, user: pd.Series) -> pd.Series:
        names = ("title", "year", "user", "rating")
        return pd.Series([[dict(zip(names, r, strict=True)) for r in page_rows(p, u or "")] for p, u in zip(page, user, strict=True)])

    user = F.col(user_col) if user_col else F.lit("")
    rest = [c for c in pages.columns if c not in (html_col, user_col)]
    return pages.select(*rest, F.explode(found(F.col(html_col), user)).alias("_r")).select(*rest, "_r.*")
