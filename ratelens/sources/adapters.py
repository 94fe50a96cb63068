"""Sources by name: an adapter says how saved material of a kind is read, and gives a DataFrame with a fixed schema.

Adapters read through Spark's file sources, so any store that Spark reaches works, a folder column (channel=..., day=...) prunes
what is listed, and a filter on it shows as a partition filter in the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratelens.sources import uploads

Reader = Callable[..., DataFrame]
_ADAPTERS: dict[str, Reader] = {}


def adapter(name: str) -> Callable[[Reader], Reader]:
    """Registers a reader (spark, path, **options) under a name; a name is taken once."""

    def put(reader: Reader) -> Reader:
        if name in _ADAPTERS:
            raise ValueError(f"there is an adapter {name!r} already")
        _ADAPTERS[name] = reader
        return reader

    return put


def read(spark: SparkSession, name: str, path: str, **options: object) -> DataFrame:
    """What the named adapter reads at a path."""
    if name not in _ADAPTERS:
        raise KeyError(f"no adapter {name!r}; there are {', '.join(sorted(_ADAPTERS))}")
    return _ADAPTERS[name](spark, path, **options)


class _Posts(HTMLParser):
    """[id, text, time, image] of each message of a saved channel page; the first text block of a message counts."""

    # Classes of a channel page.
    MESSAGE, TEXT, DATE = "tgme_widget_message", "tgme_widget_message_text", "tgme_widget_message_date"
    LONE = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.posts: list[dict] = []
        self.open: list[tuple[str, str]] = []  # tags with what they are: message, text, date or nothing

    def _within(self, what: str) -> bool:
        return any(w == what for _, w in self.open)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        values = {k: v or "" for k, v in attrs}
        classes, what = values.get("class", "").split(), ""
        if tag == "div" and self.MESSAGE in classes:
            what = "message"
            self.posts.append({"name": values.get("data-post", ""), "text": None, "time": None, "image": None})
        elif self._within("message"):
            post = self.posts[-1]
            if tag == "div" and self.TEXT in classes and post["text"] is None:
                what, post["text"] = "text", []
            elif tag == "a" and self.DATE in classes:
                what = "date"
            elif tag == "time" and self._within("date"):
                post["time"] = post["time"] or values.get("datetime")
            style = values.get("style", "")
            if "background-image" in style and not post["image"]:
                url = style.partition("url(")[2].partition(")")[0].strip("'\"")
                post["image"] = url if url.startswith("https://") else None
        if tag not in self.LONE:
            self.open.append((tag, what))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self._within("text") and data.strip():
            self.posts[-1]["text"].append(data.strip())


def channel_posts(pages: DataFrame, channel: str = "channel", html: str = "html") -> DataFrame:
    """channel, post_id, text, published_at (UTC), image_url of the posts of saved channel pages.

    Posts without text, time or a number are left out; a post on several pages comes once, with its latest text. Null pages have none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, page in zip(batch["channel"], batch["html"]):
                parser = _Posts()
                parser.feed(page or "")
                rows += [(name, p["name"].rpartition("/")[2], "\n".join(p["text"] or []), p["time"], p["image"]) for p in parser.posts if "/" in p["name"]]
            yield pd.DataFrame(rows, columns=["channel", "post_id", "text", "time", "image_url"])

    found = pages.select(F.col(channel).cast("string").alias("channel"), F.col(html).alias("html")).mapInPandas(run, "channel string, post_id string, text string, time string, image_url string")
    posts = found.select("channel", F.col("post_id").try_cast("long").alias("post_id"), "text", F.to_timestamp("time").alias("published_at"), "image_url")
    posts = posts.where("post_id IS NOT NULL AND text <> '' AND published_at IS NOT NULL")
    return posts.groupBy("channel", "post_id").agg(F.max(F.struct("published_at", "text", "image_url")).alias("p")).select("channel", "post_id", "p.text", "p.published_at", "p.image_url")


def newest_posts(posts: DataFrame, since: Column, most: int) -> DataFrame:
    """The newest `most` posts of each channel (the feature of a run) that were published after `since`."""
    order = Window.partitionBy("channel").orderBy(F.desc("post_id"))
    return posts.where(F.col("published_at") > since).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")


@adapter("channel_pages")
def read_channel_pages(spark: SparkSession, path: str) -> DataFrame:
    """channel, html: saved pages under folders channel=<name>."""
    return spark.read.text(path, wholetext=True).select("channel", F.col("value").alias("html"))


@adapter("dumps")
def read_page_dumps(spark: SparkSession, path: str, marker: str = "<TEXT>") -> DataFrame:
    """file, header, text: saved page dumps, a file each."""
    return uploads.read_dumps(spark, path, marker)


@adapter("delimited")
def read_uploaded_table(spark: SparkSession, path: str, synonyms: dict[str, list[str]]) -> DataFrame:
    """An uploaded csv or tsv under the library's names."""
    return uploads.read_delimited(spark, path, synonyms)
