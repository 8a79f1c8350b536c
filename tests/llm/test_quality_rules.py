import random
import re

from riskloom.llm import quality_rules as R
from pyspark.sql import functions as F


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeat = {p for ps in at.values() if len(ps) > 1 for i in ps for p in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat)


def test_counts_match_python(frame):
    rng = random.Random(8)
    words = ["a", "bb", "é😀", "x y", "#*", "|", "word", "Tail.", "\x0b"]
    texts = [None, "", " \n\t\n", "x " * 8, "x " * 9, "same line\nsame line\n\nsame line", "a b c d e f g h\x0ca b c d e f g h"]
    texts += ["".join(rng.choice(words[: rng.randint(1, 9)]) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts.append("long text " * 20_000)
    got = R.rules_report(frame(texts * 2, ids=[*range(len(texts))] * 2)).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        n, chars, symbols, dup, repeat = want = counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        failed = n < 20 or 100 * repeat > 30 * n
        assert r.base_failed == failed and not (failed and r.kept)


def test_order_does_not_change_the_verdict_and_puts_good_rules_first(frame):
    clean = "Plain words of an ordinary sentence that goes on for quite a while with no trick in it and then it ends here."
    docs = frame([clean, clean.upper(), "!! ".join(clean.split()), "1234567 " * 30, None])
    rules = R.default_rules()
    for order in (rules, rules[::-1]):
        got = {r.doc_id: r.kept for r in R.with_counts(docs).select("doc_id", R.cascade(order).alias("kept")).collect()}
        assert got == {0: True, 1: False, 2: False, 3: False, 4: False}
    never, always = R.Rule("never", F.lit(False)), R.Rule("always", F.lit(True))
    assert [r.name for r in R.order_rules(docs, [never, always])] == ["always", "never"]
    kept = R.keep_good(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [0]


def test_null_conditions_do_not_reject_and_empty_tables_pass(frame):
    assert frame(["x"]).select(R.cascade([R.Rule("null", F.lit(None).cast("boolean"))]).alias("k")).first().k is True
    assert R.rules_report(frame([])).collect() == []


def test_no_python_on_the_main_path(frame, capsys):
    R.rules_report(frame(["x"])).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)
