import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from civisight.functions import arrays, dates, html, money, text, urls


def test_folding(one):
    assert one(
        text.fold("x"), text.fold("x", True), text.fold_exact("x"), text.upper_key("x"), text.compact_key("x"), text.match_text("x"), text.slug("x"),
        x="  Ação ﻿  ÉTICA nº 1/2 Øre ") == (
        "acao etica no 1/2 øre", "acao etica no 1/2 re", "acao etica no 1/2 øre", "ACAO ETICA NO 1 2 RE", "acaoeticano12re", "acao etica no 1 2 re", "acao-etica-no-1-2-re")
    assert one(text.fold("x"), text.match_text("x"), text.slug("x"), x="") == ("", "", "item")
    assert text.snake(" Valor  Empenhado (R$)") == "valor_empenhado_r"


def test_cleaning(one):
    assert one(text.clean_text("x", ["#NULO#"]), text.clean_text("y"), text.clean_text("z", ["null"]), x=" #nulo# ", y="﻿ a \n b ", z="Null") == (None, "a b", None)
    assert one(text.strip_tags("x"), x="<b>a</b>&nbsp;b &amp; c") == ("a b & c",)
    assert one(text.doc_digits("x"), text.doc_digits("y"), x="12.3-4", y="***.12") == ("1234", "***.12")


def test_shapes(one):
    assert one(text.truncate("x", 10), text.truncate("y", 10), x="hello world again", y="hello") == ("hello w...", "hello")
    assert one(text.excerpt_around("x", ["zoe"], 3, 6), text.excerpt_around("x", ["nobody"], plain=5), x="hello da Zoé silva") == ("... da Zoé si ...", "hello")
    assert one(text.title_case("x"), text.cap_first("x"), text.word_count("x"), x="empresa s/a da Zoé") == ("Empresa S/A Da Zoé", "Empresa s/a da Zoé", 5)
    assert one(text.snippet("x", F.array(F.lit("Ana Sá"))), x="Oi. Falei com ana sa hoje! Tchau") == ("Falei com ana sa hoje!",)
    long = "começo " + "x" * 400
    assert len(one(text.snippet("x", F.array(F.lit("nada"))), x=long)[0]) == 343
    assert one(text.strip_suffix("x", "y", ["bbc"]), text.strip_suffix("z", "y"), x="A - B | BBC News", y="bbc", z="A - Zed") == ("A - B", "A - Zed")
    assert one(text.array_unique_folded(F.split("x", ",")), x="Ana,ANA, Bê,be,") == (["Ana", "Bê"],)
    assert one(text.format_id("x"), text.format_id("y"), text.format_prefix("z"), x="BR067312026", y="BR1", z="ptabc") == ("BR-06731/2026", None, "PT-ABC")
    assert [one(text.plausible_year("x"), x=v)[0] for v in ("1899", "1900", "2100", "2101", "99", "19x0")] == [None, 1900, 2100, None, None, None]


def test_any_of_pattern(one):
    words = ["ring", "ringlet", "red bolt", "a.b"]
    for value, hit in (("earring", True), ("red  bolt", False), ("red bolts", True), ("axb", False), ("a.b", True)):
        assert one(F.col("x").rlike(text.any_of(words)), x=value) == (hit,)
    assert one(F.col("x").rlike(text.any_of(["uk", "ukraine"], True)), F.col("y").rlike(text.any_of(["uk", "ukraine"], True)), x="luk", y="in ukraine") == (False, True)


def test_dates(one):
    d = dt.date
    assert one(dates.parse_date("a"), dates.parse_date("b"), dates.parse_date("c"), dates.parse_date("e"), a="01/02/2021", b="31/02/2021", c="05/03/71", e="05/03/21") == (
        d(2021, 2, 1), None, d(1971, 3, 5), d(2021, 3, 5))
    assert one(dates.date_in_text("x"), x="em 31/02/20 e 1º de março de 2024, antes 2/3/21") == (d(2024, 3, 1),)
    assert one(dates.date_in_text("x"), x="31/02/20 depois 2-3-21") == (d(2021, 3, 2),)
    assert one(dates.iso_week(F.to_date("x")), x="2021-01-01") == ("2020-W53",)
    row = one(dates.prose_date(["x", "y"], "z", 2030), dates.prose_place(["y", "x"]), x="nada", y="nada", z="http://a/2019/x/1850")
    assert (row[0].date, row[0].source, row[1]) == (d(2019, 1, 1), "url-year", None)
    assert one(dates.prose_place(["x"]), dates.prose_place(["y"]), x="Brasília, 12 de março de 2024", y="Discurso em no Recife, no dia 3 de maio de 2003") == ("Brasília", "Recife")
    assert one(dates.month_from_parts("y", "m", F.lit("f")), dates.month_from_parts("y", "n", F.lit("f")), y="2024", m="3", n="13") == ("2024-03", "f")
    assert dates.prev_closed_month(d(2024, 3, 15)) == d(2024, 2, 1)
    stamps = one(*[dates.parse_timestamp(c) for c in "abc"], a="Tue, 02 Jan 2024 10:00:00 GMT", b="2024-01-02T10:00:00-03:00", c="01/02/2024 10:11:12")
    assert [s.strftime("%d %H") for s in stamps] == ["02 10", "02 13", "01 10"]


def test_money(one):
    assert one(*[money.parse_money(c) for c in "abcd"], a="R$ 1.234,56", b="-", c="-3,5", d="") == (Decimal("1234.56"), Decimal(0), Decimal("-3.50"), Decimal(0))
    assert one(money.safe_int("a"), money.safe_int("b"), money.optional_int("b"), a=" 12 ", b="12x") == (12, 0, None)
    assert one(money.ratio(F.lit(1), F.lit(0)), money.pct_diff(F.lit(3), F.lit(2)), money.pct_diff(F.lit(3), F.lit(0))) == (0.0, 50.0, 0.0)


@pytest.mark.parametrize("raw, key", [
    ("http://www.Ex.com/a/b/?utm_source=1&q=a%20b&x=#f", "http://ex.com/a/b?q=a+b&x="),
    ("//youtube.com/embed/abc/?x=1", "https://youtube.com/watch?v=abc"),
    ("https://youtu.be/XYZ?t=3", "https://youtube.com/watch?v=XYZ"),
    ("https://duckduckgo.com/l/?uddg=https%3A%2F%2Fa.com%2Fb%3Fx%3D1&z=2", "https://a.com/b?x=1"),
    ("http://h.com", "http://h.com/"),
    ("https://youtube.com/watch?v=1&list=2", "https://youtube.com/watch?v=1"),
    ("https://open.spotify.com/embed/episode/9?oc=1", "https://open.spotify.com/episode/9"),
    ("", None),
])
def test_canonical_url(one, raw, key):
    assert one(urls.canonical_url("x"), x=raw) == (key,)


def test_urls(one):
    assert one(*[urls.absolute_url("b", c) for c in "wxyz"], b="https://h.com/a/b.html?q=1", w="d/e", x="/r", y="//o.com/p", z="http://z") == (
        "https://h.com/a/d/e", "https://h.com/r", "https://o.com/p", "http://z")
    assert one(urls.listing_url("x"), x="https://H.com/a/?page=2&b_start:int=20&x=1") == ("https://h.com/a?b_start:int=20&page=2",)
    assert one(urls.slug_after("x", "people"), urls.slug_after("x", "none"), x="https://h/people/Ana-Sa/x") == ("ana-sa", None)
    meta = one(urls.op_meta("t", "u", ["SP", "RJ"]), urls.op_meta(F.lit("Relatório"), F.lit("http://x/relatorios-op-2014.pdf"), ["SP"]), t="Op. 12 de 2019 SP RJ SP", u="http://x")
    assert (meta[0].year, meta[0].op_num, meta[0].kind, meta[0].states) == (2019, 12, "single", ["RJ", "SP"])
    assert (meta[1].year, meta[1].op_num, meta[1].kind) == (2014, None, "yearly")


def test_arrays(one):
    out = one(arrays.owners("x"), arrays.owner_names("x"), arrays.first_owner("x"), arrays.pair_up(F.split("y", ",")), x="Ana|1|50,5; Bia ; |2|;", y="r1,n1,r2,n2,r3")
    assert [tuple(o) for o in out[0]] == [("Ana", "1", "50,5"), ("Bia", "", ""), ("", "2", "")]
    assert out[1:3] == (["Ana", "Bia"], "Ana")
    assert [tuple(p) for p in out[3]] == [("r1", "n1"), ("r2", "n2")]


PAGE = """<html><head><title>T &amp; <b>x</b></title><meta name="description" content="dd"><!-- <h1>no</h1> -->
<script type="application/ld+json">{"a":[{"headline":"H","author":[{"name":"N"},"M"]}],"datePublished":"2024-01-01"}</script>
<script type="application/ld+json">{broken</script></head>
<body><nav><a href="/x">l1</a></nav><script>var t="</p>";</script><main><h2>Head</h2><p>One <b>two</b><br>three</p><ul><li><p>Item</p></li></ul>
<aside><p>skip</p></aside><p>{filler}</p></main></body></html>""".replace("{filler}", "word " * 40)


def test_html(one):
    page = html.without_code("x")
    out = one(html.first_tag_text(page, "title"), html.links(page), html.first_attr(html.tags(page, "meta"), [(("name", "description"), "content")]),
              html.jsonld_fields(html.jsonld_blocks("x")), html.body_lines(page), x=PAGE)
    assert out[0] == "T &amp; x" and [tuple(x) for x in out[1]] == [("/x", "l1")] and out[2] == "dd"
    assert (out[3].title, out[3].published_at, out[3].author_names) == ("H", "2024-01-01", ["N", "M"])
    assert out[4][:4] == ["Head", "One two three", "Item", "Item"] and out[4][4].startswith("word word")


def test_repair_json(one):
    got = [one(html.repair_json("x", "struct<a:int>"), x=v)[0] for v in ('{"a":1}', 'Sure: {"a":2} ok', "none", "[1]")]
    assert [(g.value.a if g.value else None, g.ok) for g in got] == [(1, True), (2, True), (None, False), (None, False)]


def test_jsonld_rules(one):
    block = '<script type="application/ld+json">%s</script>'
    page = block % '{"datePublished": "soon", "dateCreated": "2024-02-03", "description": "a &quot; \\"q\\"", "publisher": {"logo": {"name": "no"}, "name": "Site"}, "author": {"alternateName": "Alt"}}'
    out = one(html.jsonld_fields(html.jsonld_blocks("x")), html.decoded("y"), html.decoded("z"), x=page, y="a &amp; b", z="plain")
    assert (out[0].published_at, out[0].site_name, out[0].author_names, out[0].description) == ("2024-02-03", "Site", ["Alt"], 'a &quot; "q"')
    assert out[1:] == ("a & b", "plain")


def test_jsonld_nested(one):
    block = '<script type="application/ld+json">%s</script>'
    page = block % ('{"@graph": [{"publisher": {"name": "Site }", "description": "of the site", "address": {"geo": {"x": 1}}}, "description": "of the article", '
                    '"author": [{"name": "A", "affiliation": {"name": "X"}}, "B", {"name": "C [", "worksFor": {"address": {"geo": [1]}}}]}]}')
    out = one(html.jsonld_fields(html.jsonld_blocks("x")), x=page)[0]
    assert (out.site_name, out.description, out.author_names) == ("Site }", "of the article", ["A", "B", "C ["])


def test_short_body_is_kept(one):
    assert one(html.body_lines("x"), x="<main><p>Short</p></main>")[0] == ["Short"]


def test_jsonld_with_half_a_surrogate_pair(spark):
    block = '<script type="application/ld+json">{"headline": "Cut \\ud83d", "author": [{"name": "A \\ud83d\\ude00"}]}</script>'
    from civisight.functions.html import jsonld_blocks, jsonld_fields

    row = spark.createDataFrame([(block,)], "h string").select(jsonld_fields(jsonld_blocks("h")).alias("x")).first().x
    assert row.title.startswith("Cut ") and row.author_names == ["A \U0001f600"]


def test_batches_for_python_are_bounded_by_bytes(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    from civisight.session import tune

    @F.pandas_udf("long")
    def rows(pages: pd.Series) -> pd.Series:
        return pd.Series([len(pages)] * len(pages))

    pages = tune(spark).range(0, 64, 1, 1).select(F.expr("repeat('x', 262144 + id)").alias("page"))
    assert 1 <= pages.select(rows("page").alias("n")).agg(F.max("n")).first()[0] <= 20
