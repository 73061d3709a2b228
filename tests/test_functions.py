from pyspark.sql import functions as F

from docloom.functions import text as T


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_escaping_and_cleaning(spark):
    assert one(spark, T.escape_html(F.lit('<a href="x">&</a>'))) == ("&lt;a href=&quot;x&quot;&gt;&amp;&lt;/a&gt;",)
    assert one(spark, T.clean_fragment(F.lit(" <b>a</b>&nbsp;\u00a0 b\n<i>c</i> "))) == ("a b c",)
    assert one(spark, T.visible_text(F.lit("<style>p{}</style><p>x</p><script>1<2</script>y"))) == ("x y",)
    assert one(spark, T.strip_tags(F.lit("a<b>c</b>"))) == ("ac",)
    assert one(spark, T.json_in_html(F.lit('{"a":"</script>"}'))) == ('{"a":"\\u003c/script>"}',)
    html = 'x<main id="main"><p>a</p><ul class="links"><li>no</li></ul><section class="app x">no</section></main>y'
    assert one(spark, T.main_content(F.lit(html))) == ("<p>a</p>",)


def test_sizes_and_numbers(spark):
    for n, shown in ((0, "0 Б"), (1023, "1023 Б"), (1024, "1,0 КБ"), (1536, "1,5 КБ"), (10239, "10,0 КБ"), (10240, "10 КБ"), (1048576, "1,0 МБ"), (5 * 1048576 + 600_000, "5,6 МБ")):
        assert one(spark, T.human_size(F.lit(n).cast("long"))) == (shown,)
    for n, shown in ((500_000, "500 КБ"), (2_000_000, "2 МБ"), (1_500, "1.5 КБ")):
        assert one(spark, T.limit_label(F.lit(n).cast("long"))) == (shown,)
    words = [one(spark, T.plural(F.lit(n), "a", "b", "c"))[0] for n in (1, 2, 5, 11, 12, 21, 22, 101, 111)]
    assert words == ["a", "b", "c", "c", "c", "a", "b", "a", "c"]
    assert one(spark, T.half_up(F.lit(-2.5)), T.half_up(F.lit(2.5))) == (-2, 3)
    assert one(spark, T.percent_change(F.lit(50), F.lit(200))) == (-75,)


def test_fitted_size(spark):
    cases = [
        (400, 200, "percent", 0, 0, 50, (200, 100)), (400, 200, "width", 100, 0, 0, (100, 50)), (400, 200, "height", 0, 100, 0, (200, 100)),
        (400, 200, "fit", 100, 100, 0, (100, 50)), (400, 200, "exact", 30, 40, 0, (30, 40)), (3, 2, "percent", 0, 0, 1, (1, 1)),
        (400, 200, "percent", 0, 0, 100_000, (16384, 16384)), (400, 200, "none", 0, 0, 0, (400, 200)), (400, 200, "exact", 0, 0, 0, (400, 200)),
    ]
    df = spark.createDataFrame([c[:6] for c in cases], "w int, h int, mode string, pw int, ph int, pc int")
    got = df.select(T.fitted_size(*(F.col(c) for c in df.columns)).alias("s")).collect()
    assert [tuple(r["s"]) for r in got] == [c[6] for c in cases]


def test_names(spark):
    assert one(spark, T.output_name(F.lit("photo.final.PNG"), F.lit("webp"))) == ("photo.final.webp",)
    assert one(spark, T.output_name(F.lit(""), F.lit("gif"))) == ("image.gif",)
    assert one(spark, T.output_name(F.lit(None).cast("string"), F.lit("gif"))) == ("image.gif",)
    assert one(spark, T.extension(F.lit("a.b.TGZ"))) == ("tgz",)
    assert one(spark, T.sheet_suffix(F.lit("a/b:c"), F.lit(2))) == ("-a_b_c",)
    ts = F.lit("2024-03-05 07:09:11").cast("timestamp")
    assert one(spark, T.dos_time(ts), T.dos_date(ts)) == ((7 << 11) | (9 << 5) | 5, (44 << 9) | (3 << 5) | 5)
    assert one(spark, T.exif_date(F.lit("2024:03:05 07:09:11"))) == ("05.03.2024 07:09:11",)
    assert one(spark, F.hex(F.crc32(F.lit("hello").cast("binary")))) == ("3610A686",)


def test_page_range(spark):
    cases = [
        ("1-3, 5, 8-", 9, [1, 2, 3, 5, 8, 9]), ("", 3, [1, 2, 3]), (None, 2, [1, 2]), ("5-3", 9, None), ("x", 9, None), ("1 - 3", 4, [1, 2, 3, 4]),
        ("-2", 5, [1, 2]), ("3;3 2", 5, [2, 3]), ("7", 5, None), ("4–6", 5, [4, 5]), ("1", 0, None), ("", 0, None),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "spec string, total int")
    assert [r["p"] for r in df.select(T.page_range(F.col("spec"), F.col("total")).alias("p")).collect()] == [c[2] for c in cases]
