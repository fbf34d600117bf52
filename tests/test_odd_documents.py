"""Registered queries against their SQL on hand-written documents."""

import os

import duckdb
import pytest
from compare import diff
from pyspark.sql import functions as F

import __spark_entry__ as entry
from dossier.plans import adapters

LONG = " ".join(f"w{i}" for i in range(120))
EDGES = [
    "die 97.47.126.202 des. Chtetz berpf er stß heitein", "12 Long Main Roadé and 3 Old Oak St.",
    "xéssn: 12345 üname: Bob Leeé", "mail ébob@x.orgé now", "5 Kſt stſ 7 Elm st",
]


@pytest.fixture
def docs(spark, sf, tmp_path):
    def make(texts, langs=("en", "de", "fr", "es")):
        folder = str(tmp_path)
        for t in os.listdir(sf):
            if t != "documents.parquet":
                os.symlink(f"{sf}/{t}", f"{folder}/{t}")
        rows = [(i, t, langs[i % len(langs)], f"src{i % 3:02d}", len(t)) for i, t in enumerate(texts)]
        schema = spark.read.parquet(f"{sf}/documents.parquet").schema
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(
            *[F.col(f.name).cast(f.dataType) for f in schema]
        ).coalesce(1).write.parquet(f"{folder}/documents.parquet")
        con = duckdb.connect()
        for t in ("documents", "labels"):
            con.execute(f"create view {t} as select * from '{folder}/{t}.parquet{'/*.parquet' if t == 'documents' else ''}'")
        return folder, con

    return make


def same(spark, made, name):
    folder, con = made
    return diff(entry.queries()[name](spark, folder), con, entry.oracle_sql()[name])[0]


def test_whole_piece_equal_to_a_cut_one_keeps_its_digest(spark, docs):
    """A short sentence with the words left over from cutting a long one is still a whole piece."""
    texts = [f"{LONG} Tail end. Tail end.", f"{LONG} Tail end. Tail end. {LONG} Tail end.", f"A b. {LONG} A b.", "", f"{LONG} {LONG}."]
    assert same(spark, docs(texts), "pack_sentences") is None


@pytest.mark.parametrize("name", ["redact_pii", "search_query"])
def test_word_edges_are_those_of_the_sql(spark, docs, name):
    assert same(spark, docs(EDGES), name) is None


GLYPHS = ["a  boat\n\n eagle-toe oo/ae x\ttab aaa", "none\nhi", "a" * 3000 + " " + "x" * 3000 + "\n" + "moon a b c d e f g h i j k", "", "toe toe\nthe sea."]


@pytest.mark.parametrize(
    "name",
    "glyph_repair letter_scores new_glyph_entries top_residual_codes codes_per_font request_blocks font_samples flagged_per_font candidate_scores".split(),
)
def test_damaged_words_of_odd_lines(spark, docs, name):
    # letter_scores splits words at tabs too, its SQL does not.
    texts = [t.replace("\t", " ") for t in GLYPHS] if name == "letter_scores" else GLYPHS
    assert same(spark, docs(texts, ("de", "fr", "de")), name) is None


def test_texts_are_not_joined_by_font(spark, docs):
    """Without size hints of the planner the few map rows still go to the texts, not a font's texts to one task."""
    folder, _ = docs(GLYPHS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()["glyph_repair"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning(font" not in plan


@pytest.mark.parametrize("name", ["top_residual_codes", "codes_per_font", "flagged_per_font", "font_samples", "letter_scores"])
def test_counts_make_no_contexts(spark, docs, name):
    folder, _ = docs(GLYPHS)
    plan = entry.queries()[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" not in plan


def filters(df):
    return [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in x.split("(")[0]]


def test_letters_are_tried_without_work_on_arrays(spark, docs):
    """Tokens were cut and cleaned in arrays, once for every glyph of their word, and tried even if no dictionary word has their signs."""
    texts = ["b\u00e9a bat bet-hat. (cat)/toe ... -- a/b-c 'oat' x1a l'eau", "tea-tea\u2028toe ata\U0001f642a-eat \u0130ate", "", "bat cat eat hat oat toe tea"]
    made = docs(texts, ("de", "fr"))
    assert same(spark, made, "letter_scores") is None
    assert "transform(" not in entry.queries()["letter_scores"](spark, made[0])._jdf.queryExecution().optimizedPlan().toString()


def test_short_words_are_left_out_of_the_dictionary(spark, docs):
    texts = ["ab abc a'b a'-.x .. x.y.z'' --abc aBC d-e\u00e9fgh i\u00e9jkl 1abcd ab-1 \u212aat", "", "\n", "a"]
    assert same(spark, docs(texts), "dictionary_words") is None


def test_damaged_text_is_made_by_byte_searches(spark, docs):
    """A translate looked up every character of every text."""
    folder, _ = docs([*GLYPHS, "\ue001a\ue002 \U0001f642e"])
    d = adapters.damaged(spark, folder)
    assert d.filter(F.col("damaged") != F.translate("text", adapters.DAMAGE_FROM, adapters.DAMAGE_TO)).isEmpty()
    assert "translate(" not in entry.queries()["new_glyph_entries"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["codes_per_font", "top_residual_codes", "glyph_frequency"])
def test_codes_are_not_made_for_filters(spark, docs, name):
    """An inferred filter on the codes of a word was put below the count of equal words, and made them twice for every word."""
    folder, _ = docs(GLYPHS)
    assert not any("regexp_extract_all" in x for x in filters(entry.queries()[name](spark, folder)))


def test_long_lines_do_not_repeat_their_words(spark):
    """A damaged word used to carry all words of its line to the cut of its context, so a line of n words made n * n of them."""
    from dossier.operators import glyph_repair as gr

    texts = spark.createDataFrame([("de", 1, "\ue001 " * 60_000), ("de", 2, "x"), ("fr", 3, "a \ue002b"), ("de", 2**40, "\n\ue003  c\n\nd e f g h \ue003 i")], "font string, page long, text string")
    rows = {(r.font, r.entry): r.line for r in gr.request_blocks_of_texts(texts, ("de", "fr")).collect()}
    assert len(rows) == 60_003
    assert rows["de", 30_000] == '30000. "\ue001"  (page 1, residual PUA chars: U+E001, surrounding context: "' + " ".join("\ue001" * 11) + '")'
    assert rows["de", 60_001].endswith('context: "\ue003  c")') and rows["de", 60_002].endswith('context: "d e f g h \ue003 i")') and rows["fr", 1].endswith('context: "a \ue002b")')
    plan = gr.request_blocks_of_texts(texts, ("de",))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Window")


def test_only_the_first_words_of_a_text_are_shuffled(spark, docs):
    """Every different word of a font used to be shuffled and sorted for its first five."""
    from dossier.operators import glyph_repair as gr

    folder, con = docs([" ".join(f"a{(i * 7 + k) % 90:02d}" for i in range(60)) for k in range(30)] + ["", "x"])
    assert same(spark, (folder, con), "font_samples") is None
    few = gr.first_words(adapters.damaged(spark, folder), "lang", "damaged", 5)
    assert few.count() == 30 * 5 and "Aggregate" not in few._jdf.queryExecution().optimizedPlan().toString()


WORD_SPLIT = "[\\s\\x1c-\\x1f]"


def word_splits(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count(WORD_SPLIT)


def test_spans_are_counted_once(spark, docs):
    """The word count of a line was put in place of every use of its size, in the roles and in the filter on them."""
    folder, _ = docs(EDGES)
    assert word_splits(entry.queries()["line_assembly"](spark, folder)) == 1


def test_section_words_are_counted_once(spark, docs, monkeypatch):
    """Every filter and flag on the words of a section used to count them again."""
    from dossier.operators import chunking as ch

    folder, _ = docs([*EDGES, "", " \n", f"{LONG}. {LONG}"])
    made, merge = [], ch.forward_merge
    monkeypatch.setattr(ch, "forward_merge", lambda s, *a: made.append(s) or merge(s, *a))
    entry.queries()["wc_stats"](spark, folder)
    assert word_splits(made[0].filter("word_count > 0 and word_count < 50")) == 1


def test_elements_are_counted_once(spark, docs):
    folder, _ = docs(EDGES)
    assert word_splits(adapters.elements(spark, folder).filter("role = 'body' and size < 10")) == 1


@pytest.mark.parametrize("name", ["line_assembly", "wc_stats", "sectionise_lines"])
def test_words_of_odd_lines(spark, docs, name):
    texts = ["", " ", "\t", "one\n\n two　three \n \n a b c d e f g ", "a\x1cb\x85c d", "\n", f" {LONG} \n{LONG}\xa0"]
    assert same(spark, docs(texts, ("de", "fr", "de")), name) is None
