"""Porter (1980): the paper's examples, the extended rules, and stemming inside ROUGE."""

import pytest

from lethe.operators.stemming import porter_stem, stem_token
from lethe.operators.scoring import text_scores

PAPER = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat",
    "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor",
    "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
    "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
    "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit",
    "rational": "ration", "digitizer": "digit", "vietnamization": "vietnam", "predication": "predic",
    "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope",
    "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl",
    "triplicate": "triplic", "formative": "form", "formalize": "formal", "electriciti": "electr",
    "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv",
    "allowance": "allow", "inference": "infer", "airliner": "airlin", "gyroscopic": "gyroscop",
    "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac",
    "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "homologou": "homolog",
    "communism": "commun", "activate": "activ", "angulariti": "angular", "homologous": "homolog",
    "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas",
    "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil",
}


@pytest.mark.parametrize("word,stem", sorted(PAPER.items()))
def test_paper_examples(word, stem):
    assert porter_stem(word, extended=False) == stem


EXTENDED = {
    "ties": "tie", "dies": "die", "died": "die", "flies": "fli", "tied": "tie", "cried": "cri", "enjoy": "enjoy",
    "happy": "happi", "dying": "die", "skies": "sky", "news": "news", "innings": "inning", "hopefully": "hope",
    "possibly": "possibl", "geology": "geolog", "rationally": "ration", "operationally": "oper", "by": "by",
    "succeed": "succeed", "agreed": "agre", "falling": "fall", "hopping": "hop", "say": "say", "ponies": "poni",
}


@pytest.mark.parametrize("word,stem", sorted(EXTENDED.items()))
def test_extended_words(word, stem):
    assert porter_stem(word) == stem


def test_short_tokens_unchanged():
    assert stem_token("ties") == "tie" and stem_token("sky") == "sky" and stem_token("was") == "was"


def test_stemmed_rouge(spark):
    df = spark.createDataFrame([(0, "the cats are running", "a cat runs")], "k int, r string, h string")
    plain = text_scores(df, "k", "r", "h", rouge_l=True).first()
    stemmed = text_scores(df, "k", "r", "h", rouge_l=True, stem=True).first()
    assert plain["rouge1"] == 0.0
    assert stemmed["rouge1"] == pytest.approx(2 * (2 / 3) * (2 / 4) / (2 / 3 + 2 / 4))


def test_sql_stemmer_agrees_with_python():
    """The oracle's SQL stemmer and the UDF's stemmer are written apart;
    they must agree on every word of the conversations (the texts the
    stemmed query scores) and the paper's list."""
    import duckdb

    from conftest import SF0001
    from lethe.plans import sqlbits as sb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF0001}/conversations.parquet')")
    words = [r[0] for r in con.execute(
        f"SELECT DISTINCT unnest({sb.rouge_tokens('text')}) FROM conversations").fetchall()]
    words = sorted(set(words) | set(PAPER) | set(EXTENDED))
    con.execute("CREATE TABLE w AS SELECT unnest(?) AS t", [words])
    ctes, name = sb.porter_ctes("w", "t")
    got = dict(con.execute(f"WITH {ctes} SELECT t, s FROM {name}").fetchall())
    assert len(words) > 1000
    assert [t for t in words if got[t] != stem_token(t)] == []
