"""Saved marketplace pages: search results, item pages, descriptions.

Python parses the markup, in Arrow batches; the texts it takes out are turned into prices, conditions and dates by
the column functions of functions.text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements and class words that are no part of a description (fixed values).
DROPPED_TAGS = frozenset(("style", "script", "nav", "footer", "header"))
DROPPED_CLASSES = frozenset(("nav", "menu", "sidebar"))

#: Pages and bytes that an Arrow batch between the JVM and Python may have, as a parsed page takes many times its size.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 200, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack += reversed(n.children)
        return "".join(out)

    def find(self, test) -> Node | None:
        return next((n for n in self.walk() if test(n)), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def _class(name: str):
    return lambda n: name in n.classes


def _text(node: Node | None) -> str | None:
    return node.text() if node else None


def search_rows(html: str | None) -> list[tuple]:
    """(url, title, price, subtitle, shipping, text, classes) of every card of a search page that has one price."""
    root = parse(html)
    cards = [n for n in root.walk() if n.tag == "li" and "s-card" in n.classes and "data-viewport" in n.attrs] or [n for n in root.walk() if n.tag == "li" and "s-item" in n.classes and n.attrs.get("id")]
    out = []
    for c in cards:
        link = c.find(_class("s-card__link")) or c.find(lambda n: n.tag == "a" and "/itm/" in n.attrs.get("href", "")) or c.find(_class("s-item__link"))
        price = _text(c.find(_class("s-card__price")) or c.find(_class("s-item__price")))
        if "to" in (price or ""):
            continue
        subtitle = " ".join(n.text().strip() for n in c.walk() if {"s-card__subtitle-row", "s-item__subtitle"} & set(n.classes)) or c.text()
        shipping = _text(c.find(lambda n: n.tag == "span" and "delivery" in n.text().lower()))
        classes = " ".join(x for n in c.walk() for x in n.classes)
        out.append((link.attrs.get("href") if link else None, _text(c.find(_class("s-card__title")) or c.find(_class("s-item__title"))), price, subtitle, shipping, c.text(), classes))
    return out


def search_listings(pages: DataFrame) -> DataFrame:
    """One row for each listing of each search page; cards without an id are dropped.

    Pages are parsed and given on one at a time, and reach Python in batches bounded by `BATCH`.
    """
    fields = "page_id bigint, url string, title string, price_text string, subtitle string, shipping string, text string, classes string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, h in zip(b.page_id, b.html):
                yield pd.DataFrame([(p, *row) for row in search_rows(h)], columns=[f.split()[0] for f in fields.split(", ")])

    for key, most in BATCH.items():
        if not 0 < int(pages.sparkSession.conf.get(key).rstrip("b")) <= most:
            pages.sparkSession.conf.set(key, most)
    rows = pages.select("page_id", "html").mapInPandas(run, fields).withColumn("listing_id", X.listing_id(F.split_part("url", F.lit("?"), F.lit(1)))).where("listing_id IS NOT NULL")
    c = F.col
    return rows.select("page_id", "listing_id", X.clean_title(c("title")).alias("title"), X.card_price(c("price_text")).alias("price"), X.price_currency(c("price_text")).alias("currency"), X.condition(c("subtitle")).alias("condition"), X.shipping_cost(c("shipping")).alias("shipping"), X.sold_date(c("text")).alias("sold_date"), X.buying_format(c("classes")).alias("buying_format"))


ITEM = "title string, price_text string, condition_text string, buttons string, warning string, message string, canonical string"


def item_fields(html: str | None) -> tuple:
    root = parse(html)
    price = root.find(_class("x-price-primary"))
    span = price.find(_class("ux-textspans")) if price else None
    warning = root.find(_class("ux-message--INLINE-WARNING"))
    condition = root.find(_class("x-item-condition-text"))
    canonical = root.find(lambda n: n.tag == "link" and n.attrs.get("rel") == "canonical")
    return (_text(root.find(_class("x-item-title__mainTitle"))), (_text(span) or _text(price) or "").strip() or None, _text(condition), _text(root.find(_class("x-buybox-cta"))), _text(warning), _text(root.find(_class("d-statusmessage"))), canonical.attrs.get("href") if canonical else None)


def item_listings(pages: DataFrame) -> DataFrame:
    """The fields of one item page each."""

    @F.pandas_udf(ITEM)
    def fields(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([item_fields(h) for h in html], columns=[f.split()[0] for f in ITEM.split(", ")])

    rows = pages.select("page_id", fields("html").alias("f")).select("page_id", "f.*")
    c = F.col
    return rows.select("page_id", "title", X.item_price(c("price_text")).alias("price"), X.price_currency(c("price_text")).alias("currency"), X.condition(F.coalesce("condition_text", F.lit("")), X.ITEM_CONDITIONS).alias("condition"), X.listing_status(c("warning"), c("message"), c("title")).alias("status"), X.purchase_format(c("buttons"), c("price_text")).alias("purchase_format"), F.coalesce(F.contains("canonical", F.lit("/p/")), F.lit(False)).alias("is_catalog"))


def cleaned_text(html: str | None) -> str | None:
    """Text without scripts, navigation and menus, white space collapsed; null if blank."""
    root, out = parse(html), []
    stack: list = [root]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag not in DROPPED_TAGS and not any(part in DROPPED_CLASSES for c in n.classes for part in c.lower().split("-")):
            stack += reversed(n.children)
            if n.tag in ("p", "br", "div", "li", "h1", "h2", "h3", "td", "tr"):
                out.append(" ")
    return re.sub(r"\s+", " ", "".join(out).replace("\xa0", " ")).strip() or None


@F.pandas_udf(T.StringType())
def clean_description(html: pd.Series) -> pd.Series:
    return html.map(cleaned_text)
