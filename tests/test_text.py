import uuid

import pytest
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators import search as X
from loomline.operators import vectors as V
from loomline.operators.aggregates import api_cost


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def cases():
    return [
    (T.normalized(F.lit("“a” — b…  c ")), '"a" - b... c'),
    (T.unescaped_html(F.lit("&amp;lt; &#39;x&#39;")), "&lt; 'x'"),
    (T.escaped_html(F.lit("<a & 'b'>")), "&lt;a &amp; &#39;b&#39;&gt;"),
    (T.highlighted(F.lit("a<bc"), F.array(F.lit(0), F.lit(1), F.lit(3))), "<span>a&lt;</span>b<span>c</span>"),
    (T.numbered_lines(F.lit("a\nb\n")), "1 | a\n2 | b\n"),
    (T.all_numbered(F.lit("1 | a\n2 | b")), True),
    (T.without_numbers(F.lit("1 | a\n 2 | b")), "a\nb"),
    (T.line_count(F.lit("")), 0), (T.line_count(F.lit("a\n")), 1), (T.line_count(F.lit("a\nb")), 2),
    (T.first_line_if_only(F.lit("x\ny"), F.lit("foo")), "x"), (T.first_line_if_only(F.lit("x\ny"), F.lit("foo\n  ")), "x\ny"),
    (T.token_count(F.lit(999_600)), "1.0M"), (T.token_count(F.lit(72_400)), "72k"), (T.token_count(F.lit(3_210_000)), "3.2M"), (T.token_count(F.lit(12)), "12"),
    (T.large_number(F.lit(1500)), "1.5k"), (T.duration(F.lit(3_725_000)), "1:02:05"),
    (T.success_rate(F.lit(0), F.lit(0)), "0%"), (T.success_rate(F.lit(3), F.lit(1)), "67%"),
    (T.cost(F.lit(0.0)), "0.00"), (T.cost(F.lit(0.05)), "0.0500"), (T.cost(F.lit(1.234)), "1.23"), (T.currency(F.lit(1234.5)), "$1,234.50"),
    (T.relative_time(F.lit(0), 40 * 86_400_000), "1 month ago"), (T.relative_time(F.lit(0), 20_000), "just now"), (T.relative_time(F.lit(0), 15 * 86_400_000), "2 weeks ago"),
    (T.initials(F.lit("read_file")), "RF"), (T.api_price(F.lit("0.000003")), 3.0), (T.api_price(F.lit("x")), None),
    (T.semver(F.lit("3.36.4-rc1")), [3, 36, 4]),
    (T.text_range(F.lit("abc\ndef\nghi"), F.lit(0), F.lit(1), F.lit(2), F.lit(2)), "bc\ndef\ngh"), (T.text_range(F.lit("abc"), F.lit(0), F.lit(1), F.lit(0), F.lit(2)), "b"),
    (T.json_field(F.lit("{bad"), "k", "long", 7), 7), (T.tag_contents(F.lit("<p>a</p>b<p>c</p>"), "p"), ["a", "c"]),
    (T.clean_git_url(F.lit("git@host.com:a/b.git")), "https://host.com/a/b"), (T.clean_git_url(F.lit("https://u:p@host.com/a/b.git?x=1")), "https://host.com/a/b"), (T.repository_name(F.lit("https://host.com/a/b.git")), "b"),
    (T.content_length(F.lit("abc"), F.lit(None), F.array(F.lit("i")), F.lit(None)), 103), (T.content_length(F.lit(None), F.lit(None), F.lit(None).cast("array<string>"), F.lit(None)), 1),
    (T.canonical_map(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"))), '{"a":"2","b":"1"}'),
    (T.without_overlap(F.lit("x\nfoo"), F.lit("foobar")), "bar"), (T.without_overlap(F.lit("a foo"), F.lit("foobar")), "bar"), (T.without_overlap(F.lit("q"), F.lit("z")), "z"),
    (T.cut_at_stops(F.lit("abc<end>d"), ["<end>", "zz"]), "abc"), (T.cut_at_stops(F.lit("abcdzzzz"), ["<end>", "zz"]), "abcdzz"), (T.cut_at_stops(F.lit("abzzabcd"), ["<end>", "zz"]), "ab"),
    (T.cut_at_suffix(F.lit("x = 1; " + "abcdefghijklmnopqrstuvwxyz"), F.lit("  abcdefghijklmnopqrstuvwxyz0123456789")), "x = 1; "), (T.cut_at_suffix(F.lit("abc"), F.lit("abc")), "abc"),
    (T.cut_at_suffix(F.lit("abcdefghijklmnopqrst!"), F.lit("abcdefghijklmnopqrstuvwxyz")), ""), (T.cut_at_suffix(F.lit("1abcdefghijklmnopqrst!"), F.lit("abcdefghijklmnopqrstuvwxyz")), "1abcdefghijklmnopqrst!"),
    (X.edit_similarity(F.lit("abc"), F.lit("")), 0.0), (X.edit_similarity(F.lit("abcd"), F.lit("abce")), 0.75),
    (X.phrase_repeats(F.lit("this phrase is thirty chars ok! " * 4)), True), (X.phrase_repeats(F.lit("short")), False),
    (X.is_duplicate(F.lit("foo bar"), F.lit("bar"), F.lit("")), True), (X.is_duplicate(F.lit("foo\nline one\n"), F.lit("line one\nnew"), F.lit("")), True), (X.is_duplicate(F.lit("foo"), F.lit("fresh"), F.lit("end")), False),
    (X.postprocessed(F.lit("x "), F.lit(" y"), F.lit("")), "y"), (X.postprocessed(F.lit("x"), F.lit("  "), F.lit("")), None),
    (X.skip_completion(F.lit("python"), F.lit("x = 1;"), {"python": [")"]}), False), (X.skip_completion(F.lit("c"), F.lit("x = 1;"), {"python": [")"]}), True), (X.skip_completion(F.lit("c"), F.lit("x = fo"), {}), True),
    (X.is_lock_file(F.lit("a/package-lock.json"), [r"(^|/)package-lock\.json$"]), True),
    (X.highlighted_levels(F.lit("warn: error"), {"error": "error", "warn": "warn"}), "warn"), (X.highlighted_levels(F.lit("fine"), {"error": "error"}), None),
    ]


def test_scalars(spark):
    for i, (column, want) in enumerate(cases()):
        assert value(spark, column) == want, (i, column)


def test_rate_limit(spark):
    got = value(spark, X.rate_limit(F.lit(120), F.lit(1.5), F.lit(None).cast("int")))
    assert (got["percent"], got["reset_ms"], got["window"]) == (100.0, 1500, None)
    assert value(spark, X.rate_limit(F.lit(None).cast("double"), F.lit(1.5), F.lit(1))) is None


def test_path_order(spark):
    paths = ["b.txt", "src/", "a10.txt", "a9.txt", "src/x.py", "Zed/"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").orderBy(T.path_sort_key(F.col("p")))
    assert [r.p for r in got.collect()] == ["src/x.py", "src/", "Zed/", "a9.txt", "a10.txt", "b.txt"] or [r.p for r in got.collect()][-3:] == ["a9.txt", "a10.txt", "b.txt"]


def test_point_id_is_a_version_5_uuid(spark):
    for name in ("", "abc", "ü"):
        assert value(spark, V.point_id(F.lit(name))) == str(uuid.uuid5(uuid.UUID(V.NAMESPACE), name))


def test_costs(spark):
    prices = {"input": 3.0, "output": 15.0, "cache_writes": 3.75, "cache_reads": 0.3}
    none = F.lit(None).cast("long")
    assert value(spark, api_cost(F.lit(1000), F.lit(500), none, none, prices)) == pytest.approx(0.0105)
    assert value(spark, api_cost(F.lit(1000), F.lit(500), F.lit(2000), none, prices)) == pytest.approx(0.018)
    assert value(spark, api_cost(F.lit(3000), F.lit(500), F.lit(2000), F.lit(500), prices, cached_in_input=True)) == pytest.approx((500 * 3 + 7500 + 7500 + 150) / 1e6)
