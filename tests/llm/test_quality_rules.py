import re
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from jurybox.llm import quality_rules as qr

SPACE = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    words = [w for w in re.split(rf"[{SPACE}]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def judged(df):
    rows = qr.judge_quality(df).collect()
    return [(r.row.doc_id, (r.q.n_words, r.q.word_chars, r.q.n_symbols, r.q.n_dup_lines, r.q.n_repeat_words), r.base_failed, r.kept) for r in rows]


def check(documents, texts):
    got = sorted(judged(documents(list(enumerate(texts)))))
    assert len(got) == len(texts)
    for (i, counts, failed, kept), text in zip(got, texts):
        assert counts == brute(text), text
        assert failed == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert not (failed and kept)


def test_edges(documents):
    check(documents, [None, "", "   \n\t", "one", "é𝄞 ß\x0bx", "a b c d e " * 3, "x\nx\n x\n\nx", "# $ a|b", "the " * 5000, "w" * 20000, " lead and trail "])


@given(st.lists(st.text(alphabet="ab \n#é", max_size=60), min_size=1, max_size=12))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_random(documents, texts):
    check(documents, texts)


def test_repeats_and_empty(documents):
    assert judged(documents([])) == []
    good = "the cat and the dog were in a house by the sea with a lot of old books on it"
    rows = judged(documents([(1, good), (1, good), (None, good)]))
    assert [r[3] for r in rows] == [True] * 3


def test_keep_good(documents):
    good = "the cat and the dog were in a house by the sea with a lot of old books on it"
    df = documents([(1, good), (2, "too short"), (3, " ".join(f"w{i}### ***" for i in range(40)))])
    kept = qr.keep_good(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [1]


def test_no_user_functions(documents):
    plan = qr.judge_quality(documents([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow(?!Scan)|Exchange", plan.replace("LocalTableScan", ""))


def test_the_filter_computes_nothing_twice(documents):
    df = documents([(1, "a few words of text")])
    plans = [d._jdf.queryExecution().optimizedPlan().toString() for d in (qr.judge_quality(df), qr.keep_good(df))]
    for step in ("regexp_replace", "sort_array", "xxhash64"):
        assert plans[0].count(step) == plans[1].count(step)
