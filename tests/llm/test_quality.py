from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from siftlake.llm import quality
from tests.llm.helpers import WORD, docs, odd_docs, words


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    covered = {j for i, g in enumerate(windows) if often[g] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def check(spark, texts):
    rows = quality.quality(docs(spark, texts)).collect()
    for r in rows:
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        want = brute(r["text"] if "text" in r else None)
        assert got == want, (r["text"][:200] if r["text"] else r["text"], got, want)
        assert r["base_failed"] == (got[0] < 20 or 100 * got[4] > 30 * got[0])
        assert not (r["kept"] and r["base_failed"])
    return {r["doc_id"]: r for r in rows}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c d", "\n", "\t", "#", "é", " ", "a b a b a b a b a b"]), max_size=60), min_size=1, max_size=8))
def test_counts_against_brute_force(spark, parts):
    check(spark, [" ".join(p) for p in parts] + [None])


def test_verdicts(spark):
    clean = ". ".join(words(12, i) for i in range(8)) + "."
    menu = " | ".join(words(1, i) for i in range(60))
    shout = " ".join(w + "!!" for w in words(60, 5).split())
    marks = " ".join(w + "###" for w in words(60, 6).split())
    notice = clean + "\nAll rights reserved."
    rows = check(spark, [clean, menu, shout, marks, notice, words(15, 2), " ".join(["same words again and again in this text"] * 9), clean + "\nHome\nAbout us"])
    assert [rows[i]["kept"] for i in range(8)] == [True, False, False, False, True, False, False, True]
    assert rows[4]["clean_text"] == clean and rows[7]["clean_text"] == clean


def test_prose_that_speaks_of_notices_stays(spark):
    prose = [
        "The cookie jar stood on the shelf, and grandmother filled it every Sunday morning before church.",
        "He wanted to subscribe to the old idea that stars guide our lives and our loves.",
        *[f"It was said that {x} is what the sign over the old mill had read for years." for x in quality.NOTICES],
    ]
    for line, r in check(spark, prose).items():
        assert (r["clean_text"], r["lost_share"]) == (prose[line], 0.0)
    notices = [x for n in quality.NOTICES for x in (n, n.capitalize() + ".", f"© 2024 {n.upper()}!")]
    rows = check(spark, ["\n".join([words(30, 1) + ".", *notices])])
    assert rows[0]["clean_text"] == words(30, 1) + "."


def test_odd_rows(spark):
    df = odd_docs(spark).withColumnRenamed("lang", "clean")
    check(spark, [r["text"] for r in df.collect()])
    assert quality.quality(df).count() == 10 and quality.quality(df.limit(0)).count() == 0
