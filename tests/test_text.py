"""Tokens, cleaning, HTML, tags and stems on edge cases."""

import pytest
from pyspark.ml.feature import RegexTokenizer, StopWordsRemover, Tokenizer
from pyspark.sql import functions as F

from titleq.functions import html, stems, tags, text, words
from titleq.operators import features

EDGE = [
    "", " ", "  two  blanks  ", "\ttab and\nline ", "x's A_B", "Ünï-code Ärger", "the and of",
    "Red red RED ring", "a" * 3, "5 & 7", "end ", "   nbsp",
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(list(enumerate(EDGE)), "id int, t string")


def test_stop_words_are_the_default_list():
    assert len(words.STOP_WORDS) == 181 and len(set(words.STOP_WORDS)) == 181


def test_stop_words_equal_the_library(spark):
    assert words.STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english")


def test_ws_tokens_equal_tokenizer(edge):
    out = Tokenizer(inputCol="t", outputCol="want").transform(edge)
    for r in out.select("t", "want", text.ws_tokens(F.col("t")).alias("got")).collect():
        assert r.got == r.want, r.t


def test_words_equal_regex_tokenizer(edge, spark):
    tok = RegexTokenizer(inputCol="t", outputCol="want", pattern="\\W")
    stop = StopWordsRemover(inputCol="want", outputCol="kept")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = edge.select("t").unionByName(docs.select(F.col("text").alias("t")))
    out = stop.transform(tok.transform(rows)).select(
        "want", "kept", text.words(F.col("t")).alias("got"), text.useful_words(F.col("t")).alias("useful")
    )
    assert out.where("got <> want or useful <> kept").count() == 0


def one(spark, value, fn):
    row = spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("x")).first()
    return row.x


def test_cleaning(spark):
    assert one(spark, "a'b\"c<d/e&f[g+h>i(j)k-l]m", text.strip_special) == "a b c d e f g h i j k l]m"
    assert one(spark, None, text.strip_special) is None
    assert one(spark, "a--b/(c) it's 1.5", text.two_step_replace) == "a b c  its 15"
    assert one(spark, "a12b3", text.strip_digits) == "a b "
    assert one(spark, "The x's, the A_B!", text.title_words) == ["the", "xs", "ab"]
    assert one(spark, "Café THE the ñandú", text.fold_tokens) == ["Cafe", "THE", "nandu"]
    assert one(spark, "A_b the-C", text.clean_words) == ["b", "c"]


@pytest.mark.parametrize(
    "markup, plain",
    [
        ("a &amp;lt; b", "a &lt; b"),
        ("&#233;&#x1F600;&eacute;", "é😀é"),
        ("&bogus; & &;", "&bogus; & &;"),
        ("<b>x</b><!-- <i> --><script>if (a<b) {}</script>y", "xy"),
        ("<style>\np{}</style >z", "z"),
        ("no markup", "no markup"),
        ("&#0;&#55555555;&#xD800;", "\ufffd\ufffd\ufffd"),
    ],
)
def test_html(spark, markup, plain):
    assert one(spark, markup, html.html_to_text) == plain


@pytest.mark.filterwarnings("ignore:invalid escape:DeprecationWarning")
@pytest.mark.filterwarnings("ignore:.*invalid escape:SyntaxWarning")
def test_escapes(spark):
    for value in ("\\u00e9t\\xe9 \\n x", "a\\\\n", "\\101\\q", "plain", "\\U0001F600"):
        assert one(spark, value, html.decode_escapes) == value.encode().decode("unicode_escape")
    assert one(spark, "tail\\", html.decode_escapes) == "tail\\"


def test_clean_text(spark):
    from titleq.plans.text_queries import clean_text

    assert one(spark, "<p>The running&amp;shoes</p> R&amp;D", clean_text) == "run shoe r d"
    assert one(spark, "R&amp;D rings", clean_text) == "r amp d ring"
    assert one(spark, None, clean_text) == ""
    assert one(spark, "\\nred\\tlamps", lambda c: clean_text(c, escaped=True)) == "red lamp"


def test_tags(spark):
    got = one(spark, "Two red rings & 5 lovely, useful items", tags.tagged)
    assert [(r.tag, r.text) for r in got] == [
        ("NUM", "Two"), ("ADJ", "red"), ("NOUN", "rings"), ("SYM", "&"), ("NUM", "5"),
        ("ADV", "lovely"), ("PUNCT", ","), ("ADJ", "useful"), ("NOUN", "items"),
    ]


PORTER = """caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster
motoring motor sing sing conflated conflat troubled troubl sized size hopping hop falling fall
hissing hiss failing fail filing file happy happi sky sky relational relat conditional condit
rational ration valenci valenc digitizer digit operator oper feudalism feudal decisiveness decis
hopefulness hope formaliti formal triplicate triplic formative form electrical electr goodness good
revival reviv allowance allow inference infer airliner airlin adjustable adjust replacement replac
adoption adopt probate probat rate rate cease ceas controll control roll roll oscillators oscil
be be""".split()
SNOWBALL = """consigned consign consistency consist consolatory consolatori conspicuous conspicu
conspiracy conspiraci constables constabl knaves knave kneaded knead knightly knight knives knive
knotted knot generously generous generate generat jewellery jewelleri sunglasses sunglass
watches watch dying die skies sky proceeding proceed happily happili cry cri say say by by
hoping hope hopping hop luxuriated luxuri sensational sensat gas gas this this gaps gap kiwis kiwi
ties tie cries cri youth youth boyish boyish national nation communism communism""".split()


@pytest.mark.parametrize("stem, pairs", [(stems.porter, PORTER), (stems.snowball, SNOWBALL)])
def test_stems(spark, stem, pairs):
    df = spark.createDataFrame(list(zip(pairs[::2], pairs[1::2])), "word string, want string")
    bad = df.withColumn("got", stem(F.col("word"))).where("got <> want").collect()
    assert bad == []


def products(spark, rows):
    return spark.createDataFrame(rows, "index long, title string, description string")


def test_concise_features_on_edges(spark):
    df = products(
        spark,
        [
            (1, "Red ring & red ring!", "A red thing"),
            (2, "", None),
            (3, "the of", "\n\n"),
            (4, "lamp", "the and"),
            (5, "lamp-shade (red)", "lamp/shade"),
            (6, "&", None),
        ],
    )
    got = {r["index"]: r for r in features.concise_features(df).collect()}
    one_ = got[1]
    assert (one_.original_tokens, one_.regex_tokens, one_.nsw_tokens, one_.sw_tokens) == (6, 2, 4, 0)
    assert (one_.des_same, one_.repeat_tokens, one_.title_character_count) == (1, 2, 20)
    assert one_.tit_des_ratio == 4 / 2
    assert (got[2].original_tokens, got[2].regex_tokens, got[2].tit_des_ratio) == (1, 1, 1.0)
    assert (got[3].nsw_tokens, got[3].sw_tokens, got[3].des_tokens) == (0, 2, 0)
    assert got[4].tit_des_ratio == 1.0
    assert (got[5].original_tokens, got[5].regex_tokens, got[5].title_character_count) == (4, 1, 16)
    assert (got[6].original_tokens, got[6].nsw_tokens, got[6].title_character_count) == (0, 0, 1)


def test_tag_counts_of_an_empty_title_are_zero(spark):
    row = features.tag_counts(products(spark, [(1, "", None)])).first()
    assert row.count_noun == 0 and row.freq_noun == 0.0


def test_price_keeps_unlisted_countries(spark):
    df = spark.createDataFrame([("my", 2.0), ("sg", 2.0), ("ph", 2.0), (None, 2.0)], "c string, p double")
    price = features.price_in(F.col("p"), F.col("c"), {"my": 12.0, "sg": 37.0})
    assert [r[0] for r in df.select(price).collect()] == [24.0, 74.0, 2.0, 2.0]


@pytest.mark.parametrize("most", [0, 3, 1 << 18])
def test_frequent_words_are_stemmed_once(spark, monkeypatch, most):
    """Looked up or not, every word of a list gets its stem; texts may be empty, ids null or repeated."""
    monkeypatch.setattr(features, "STEMMED_WORDS", most)
    listed = [SNOWBALL[::2], [], ["hoping"] * 5 + ["x" * 70 + "ing", "a"], ["hoping", "gas"]]
    rows = [(i, a, b) for i, a, b in zip([1, None, 2, 2], listed, listed[::-1])]
    df = spark.createDataFrame(rows, "index long, a array<string>, b array<string>").repartition(2)
    want = df.select("index", *[stems.stems(F.col(c)).alias(c) for c in "ab"])
    got = features.stemmed_lists(df, ["a", "b"])
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_looked_up_words_are_not_stemmed_again(spark):
    """The stem of a frequent word is taken once, not for each of its places."""
    df = spark.range(50).select(F.col("id").alias("index"), F.array(F.lit("hoping"), F.lit("gas")).alias("a"))
    kinds = iter([lambda w: F.left(w, F.lit(3)), lambda w: F.raise_error(F.lit("stemmed again")).cast("string")])
    got = features.stemmed_lists(df, ["a"], lambda w: next(kinds)(w))
    assert {tuple(r.a) for r in got.collect()} == {("hop", "gas")}
