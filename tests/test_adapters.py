"""Sources by name, and posts of saved channel pages."""

import datetime

import pytest
from pyspark.sql import functions as F

from ratelens.sources import adapters


def message(name, text="<b>Новый</b> цех<br>открыт &amp; работает", time="2026-10-05T12:00:00+03:00", image=""):
    body = f'<div class="tgme_widget_message_text js-message_text" dir="auto">{text}</div>' if text is not None else ""
    stamp = f'<a class="tgme_widget_message_date" href="#"><time datetime="{time}">12:00</time></a>' if time else ""
    return f'<div class="tgme_widget_message_wrap"><div class="tgme_widget_message text_not_supported_wrap" data-post="{name}"><a style="{image}"></a>{body}{stamp}<img src="x"></div></div>'


def test_posts_of_a_page(spark):
    inner = '<div class="tgme_widget_message_text">вложено</div>'
    page = "".join([message("a/1"), message("a/2", None), message("a/3", time=None), message("a/x"), message("noslash"), message("a/4", f"первый {inner}", image="width:1px;background-image:url('https://cdn.x/i.jpg')"), message("a/5", "  ", image="background-image:url('http://x/i.jpg')"), message("a/6", "утро", "2026-10-05T07:30:00")])
    rows = spark.createDataFrame([("a", "<html>" + page), ("a", page), ("b", None), ("b", "")], "channel string, html string")
    got = {(r.channel, r.post_id): (r.text, r.published_at, r.image_url) for r in adapters.channel_posts(rows).collect()}
    noon, morning = datetime.datetime(2026, 10, 5, 9), datetime.datetime(2026, 10, 5, 7, 30)
    assert got == {("a", 1): ("Новый\nцех\nоткрыт & работает", noon, None), ("a", 4): ("первый\nвложено", noon, "https://cdn.x/i.jpg"), ("a", 6): ("утро", morning, None)}


def test_newest(spark):
    rows = spark.createDataFrame([(c, i, "t", datetime.datetime(2026, 10, i)) for c in "ab" for i in range(1, 9)], "channel string, post_id long, text string, published_at timestamp")
    got = sorted((r.channel, r.post_id) for r in adapters.newest_posts(rows, F.lit(datetime.datetime(2026, 10, 6)), 5).collect())
    assert got == [("a", 7), ("a", 8), ("b", 7), ("b", 8)]
    assert adapters.newest_posts(rows, F.lit(datetime.datetime(2026, 1, 1)), 3).count() == 6


def test_adapters_by_name_prune_folders(spark, tmp_path):
    for channel in ("a", "b"):
        (tmp_path / f"channel={channel}").mkdir()
        (tmp_path / f"channel={channel}" / "1.html").write_text(message(f"{channel}/1"), encoding="utf-8")
    pages = adapters.read(spark, "channel_pages", str(tmp_path))
    assert sorted(r.channel for r in adapters.channel_posts(pages).collect()) == ["a", "b"]
    one = pages.where("channel = 'b'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(channel" in plan and [r.channel for r in one.collect()] == ["b"]
    (tmp_path / "t.csv").write_text("Банк;Ставка\nA;5\n", encoding="utf-8")
    assert adapters.read(spark, "delimited", str(tmp_path / "t.csv"), synonyms={"bank": ["банк"]}).first().bank == "A"
    with pytest.raises(KeyError, match="channel_pages"):
        adapters.read(spark, "nothing", "x")
    with pytest.raises(ValueError):
        adapters.adapter("dumps")(lambda spark, path: None)
