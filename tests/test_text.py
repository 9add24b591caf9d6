from pyspark.sql import functions as F

from weftline.functions import places as P
from weftline.functions import text as X
from weftline.functions import urls as U
from weftline.functions.html import page_parts
from weftline.plans.analyze import validate


def one(spark, c, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<int>' if isinstance(v, list) else 'int'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(c.alias("x")).first().x


def test_whitespace_and_escape(spark):
    assert one(spark, X.no_space(F.col("s")), s=" a　b \n") == "ab"
    assert one(spark, X.one_space(F.col("s")), s="　a \n b　") == "a b"
    assert one(spark, X.no_space(F.col("s")), s=None) == ""
    assert one(spark, X.one_space(X.escape_html(F.col("s"))), s="a<b>\n 'c'  ") == "a&lt;b&gt; &#x27;c&#x27;"


def test_validation(spark):
    rows = [("", "t", "b", ""), ("<script>x</script>", "t", "b", None), ("g", "x" * 201, "b", "u" * 101), ("g", "t", " 　", "unit")]
    df = spark.createDataFrame(rows, "tag string, title string, body string, forced_unit string")
    got = validate(df).collect()
    assert [r.is_valid for r in got] == [False, True, False, False]
    assert got[0].errors == ["标签不能为空"] and len(got[2].errors) == 2 and got[1].tag == "&lt;script&gt;x&lt;/script&gt;"
    assert [r.is_valid for r in validate(df, strict=True).collect()][1] is False


def test_suspicious_words_and_rules(spark):
    assert one(spark, X.first_pattern(F.col("s")), s="a ONLOAD = 1; select") == "事件处理器注入"
    assert one(spark, X.first_pattern(F.col("s")), s="北京select市") is None
    assert one(spark, X.listed_words(F.col("s")), s="领导人与政府") == ["政府", "领导人"]
    assert one(spark, X.labels_by_rule(F.col("s")), s="违停 停车 垃圾") == ["垃圾清运", "停车秩序"]
    assert one(spark, X.first_label(F.col("s")), s="无关") == "诉求"


def test_terms_snippets_matches(spark):
    q = "小区垃圾没人清理，我们投诉过三次了请尽快处理 ok"
    assert one(spark, X.query_terms(F.col("s"), F.lit("朝阳区")), s=q) == ["垃圾清运", "朝阳区", "小区垃圾没人清理", "我们投诉过三次了请尽", "快处理", "ok"]
    for n, end in ((159, ""), (160, ""), (161, "...")):
        assert one(spark, X.snippet(F.col("s")), s="字" * n) == "字" * min(n, 160) + end
    terms = F.split(F.lit("a b c d e f g h i j"), " ")
    assert one(spark, X.matched_terms(terms, F.col("s")), s="abcdefghij") == list("abcdefgh")
    assert one(spark, X.distinct_matches(F.col("s"), "(?:北京市)?[^，。；；、\\n]{0,20}(?:区|镇|乡|街道|路|街|村|社区|园|大厦|广场)"), s="北京市朝阳区望京街道，海淀区中关村") == ["北京市朝阳区望京街道", "海淀区中关村"]


def test_reply_cleaning(spark):
    raw = "关于噪声的回复信\n您于2025年3月1日反映的问题，现答复如下：已完成清运并安排复查。\n感谢您对我们工作的理解与支持！\n某某街道办\n2025年3月2日"
    assert one(spark, X.clean_reply(F.col("s")), s=raw) == "已完成清运并安排复查。"
    assert one(spark, X.is_low_quality(F.col("s")), s="问题已转办") and not one(spark, X.is_low_quality(F.col("s")), s="已转办" + "长" * 120)
    assert one(spark, X.is_on_site_negative(F.col("s")), s="经现场核查，未发现问题")
    assert one(spark, X.tidy_generated(F.col("s")), s="您好，已处理。感谢您的来信\n再见") == "已处理。"


def test_chat_markup(spark):
    turns = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in (("user", "q"), ("tool", "1"), ("tool", "2"), ("assistant", "a"))])
    out = one(spark, X.render_chat(turns, "S"))
    assert out == "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>user\n<tool_response>\n1\n</tool_response>\n<tool_response>\n2\n</tool_response><|im_end|>\n<|im_start|>assistant\na<|im_end|>\n<|im_start|>assistant\n"


def test_supervised_examples(spark):
    got = one(spark, X.supervised_example(F.col("p"), F.col("a"), 2, 6), p=[1, 2], a=[7, 8, 9, 9])
    assert got.input_ids == [1, 2, 7, 8, 9, 2] and got.labels == [-100, -100, 7, 8, 9, 2]
    got = one(spark, X.supervised_example(F.col("p"), F.col("a"), 2, 4), p=[1, 2, 3, 4, 5], a=[7])
    assert got.input_ids == [1, 2, 3, 2] and got.labels == [-100, -100, -100, 2]


def test_places(spark):
    cat = lambda n, g="": one(spark, P.taxonomy_category(F.col("n"), F.col("g")), n=n, g=g)
    assert [cat("西单公交站"), cat("望京小区"), cat("长安街"), cat("某处"), cat("x", "street"), cat("人民医院")] == ["bus_stop", "community", "road", "poi_misc", "street", "hospital"]
    assert one(spark, P.purified_category(F.col("n")), n="小学医院") == "school" and one(spark, P.purified_category(F.col("n")), n="望京") == "community"
    assert one(spark, P.clean_alias(F.col("n"), F.lit("street")), n="北京市望京街道办") == "北京市望京街道" and one(spark, P.clean_alias(F.col("n"), F.lit("x")), n="甲") == ""
    assert one(spark, P.curated_name(F.col("n"), F.lit("subway_station")), n="西单（地铁站）地铁站") == "西单"
    assert one(spark, P.community_name(F.col("n")), n="望京新城(东门)A区") == "望京新城A区" and one(spark, P.community_name(F.col("n")), n="望京居委会小区") == ""
    k = lambda n, loc: tuple(one(spark, P.place_key(F.col("n"), F.col("l")), n=n, l=loc))
    assert k("甲", "116.40012,39.90049") == k("甲", "116.4004,39.9001") == ("甲", 116.4, 39.9, None)
    assert k("甲", "") == ("甲", None, None, "") and k("甲", "x,1") == ("甲", None, None, "x,1")
    assert one(spark, P.district_by_list(F.col("n")), n="海淀与朝 阳") == "朝阳区" and one(spark, P.district_by_position(F.col("n"), F.lit("")), n="海淀与朝阳") == "海淀区"
    assert one(spark, P.plausible_station(F.col("n")), n="西单") and not one(spark, P.plausible_station(F.col("n")), n="票价") and not one(spark, P.plausible_station(F.col("n")), n="abc")
    assert P.grid(spark, 39.5, 39.6, 116.0, 116.1, 0.05).count() == 9


def test_urls_and_pages(spark):
    assert one(spark, U.without_parameter(F.col("u")), u="http://h/p?Key=1&a=2&key=3#f") == "http://h/p?a=2#f" and one(spark, U.without_parameter(F.col("u")), u="http://h/p?key=1") == "http://h/p"
    asked = one(spark, U.asked(F.col("u")), u="http://h/?keywords=%E6%9C%9D%E9%98%B3%E5%8C%BA%E5%B0%8F%E5%8C%BA")
    assert tuple(asked) == ("朝阳区", "小区", 1)
    assert one(spark, U.document_id(F.col("u")), u="http://a") == "b91b9b6d8b5d"[:0] + one(spark, F.substring(F.md5(F.col("u")), 1, 12), u="http://a")
    nxt = lambda t, c: spark.createDataFrame([(t, c)], "t int, c array<int>").select(U.next_page(F.col("t"), F.col("c")).alias("x")).first().x
    assert [nxt(None, []), nxt(None, [1]), nxt(3, [1, 3]), nxt(2, [1, 2]), nxt(0, [])] == [1, 2, 2, None, None]


def test_html_parts():
    page = "<title>t</title><body><div class='x-content'>a <script>no</script><b>b</b><nav>n</nav> &amp; c</div><h1> H  1 </h1>"
    assert page_parts(page) == ("H 1", "a b & c")
    assert page_parts("<p class=subTitle>T</p><article>in</article>") == ("T", "in") and page_parts(None) == (None, "") and page_parts("<b>") == (None, "")
