"""HTML to text against the parser of the standard library, and CSV files that keep every text."""

from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from titleq.functions import html
from titleq.sources import readers, writers


class Text(HTMLParser):
    """The text outside of scripts and styles."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def parsed(markup):
    parser = Text()
    parser.feed(markup)
    parser.close()
    return "".join(parser.out)


SNIPPETS = [
    "a < b and c > d", "1<2", "x <- y", "<p>one<p>two", "<b class='x>y'>z</b>", '<a title="1 > 0" href=x>t</a>', "<img alt='it' src=a/b>t",
    "<br/>x<br />y", "</b>x", "</ b>x", "< b>x", "<1>x", "a<", "a<b", "<a =\">\">t", "<a b = 'c>d' e>t", "<p\nclass=\"k\"\n>t</p\n>",
    "<!DOCTYPE html><p>t", "<!-- a > b -->t", "<!-- <b>x</b> -->t", "<?xml version='1.0'?>t", "<script>if (a<b && c>d) {}</script>t",
    "<STYLE>p > a {}</STYLE>t", "<script src=\"x>y\">z</script>t", "&lt;b&gt; &amp;amp; &quot;", "&copy; &copy 2024 &notin; &not x", "&AMP;&amp &nbsp;.",
    "&#65;&#x41;&#X41;&#65", "&#128;&#150;&#x9f;", "&nosuch; &; & &&", "&hellip;&rarr;&NotEqualTilde;", "a &lt b", "<td title=\"a'b\">c</td>", "<a title='a\"b'>c</a>", "<x-y:z>t</x-y:z>",
]


def test_snippets_equal_the_parser(spark):
    df = spark.createDataFrame([(s,) for s in SNIPPETS], "s string")
    got = {r.s: r.t for r in df.select("s", html.html_to_text(F.col("s")).alias("t")).collect()}
    wrong = {s: (got[s], parsed(s)) for s in SNIPPETS if got[s] != parsed(s)}
    assert not wrong


def test_pages_equal_the_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = pages.select("html", html.html_to_text(F.col("html")).alias("t")).collect()
    assert len(rows) == 2500
    assert not [r for r in rows if r.t != parsed(r.html)]


def test_long_tags_need_no_stack(spark):
    markup = "<a " + " ".join(f"x{i}='>{i}'" for i in range(3000)) + ">t" + "<b" * 2000
    got = spark.createDataFrame([(markup,)], "s string").select(html.strip_tags(F.col("s"))).first()[0]
    assert got == "t" + "<b" * 2000


TEXTS = [
    "a\nb", "", None, 'q "x", y\r\nz', " lead trail ", "\\N", '"', "\n", "a\\", '\\"', ",", "\t", "\r", "é\n\n🙂", "#c", '""',
    'a"b\nc"d', '"quoted"', " ", "null", "\\\\n", "''", "a,b\n\n,c",
]


@pytest.mark.parametrize("header", [True, False])
@pytest.mark.parametrize("files", [None, 1])
def test_csv_keeps_every_text(spark, tmp_path, header, files):
    path = str(tmp_path / "rows.csv")
    df = spark.createDataFrame([(i, t, "end") for i, t in enumerate(TEXTS)], "i long, t string, u string").repartition(4)
    writers.write_csv(df, path, header=header, sort="i", files=files)
    back = readers.read_csv(spark, path, "i long, t string, u string", header=header)
    assert sorted((r.i, r.t, r.u) for r in back.collect()) == [(i, t, "end") for i, t in enumerate(TEXTS)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:  # many splits of one file
        assert sorted((r.i, r.t) for r in back.select("i", "t").collect()) == list(enumerate(TEXTS))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("text", [f"a{writers.RECORD_END}b", writers.NULL])
def test_csv_refuses_what_it_cannot_keep(spark, tmp_path, text):
    df = spark.createDataFrame([(1, text)], "i long, t string")
    with pytest.raises(Exception, match="record end"):
        writers.write_csv(df, str(tmp_path / "rows.csv"))


def test_csv_of_other_writers(spark, tmp_path):
    (tmp_path / "plain.csv").write_text('1,"a ""b"", c"\n2,\n')
    back = readers.read_csv(spark, str(tmp_path / "plain.csv"), "i long, t string", line_end=None, null="")
    assert sorted((r.i, r.t) for r in back.collect()) == [(1, 'a "b", c'), (2, None)]
