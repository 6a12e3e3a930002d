import random
import re
from collections import Counter

from pointweave.llm import rules


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [l for l in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", l)]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    return dict(n_words=len(words), word_chars=sum(map(len, words)), n_symbols=len(re.findall(r"[#*$%&|<>]", text)),
                n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(covered), n_lines=len(lines),
                n_capitals=sum(c.isupper() for c in text))


def texts():
    rng = random.Random(1)
    out = [None, "", "  \n ", "one", "a b c", "a b c a b c", "a a a a a", "x y\n\nx y\n x y", "été\x85é \x1c|# <b>", "ab c a bc ab c",
           "word " * 30000, "# " * 60, " ".join(f"word{i}" for i in range(60))]
    return out + ["".join(rng.choice(["aa", "B", "c#", " ", " ", "\n", "\t", "é "]) for _ in range(rng.randint(5, 300))) for _ in range(60)]


def test_measurements_bits_and_policies(docs):
    rows = {r.doc_id: r for r in rules.ledger(docs(texts()).withColumnRenamed("lang", "failed")).collect()}
    for i, text in enumerate(texts()):
        want = plain(text)
        assert {k: rows[i][k] for k in want} == want, text
        for name, condition in rules.RULES:
            fails = eval(condition.replace("OR", "or"), {}, want)
            assert bool(rows[i].failed & rules.BIT[name]) == fails


def test_ablations_follow_the_ledger(docs):
    ledger = rules.ledger(docs(texts()))
    rows = ledger.collect()
    got = {(r.policy, r.rule): r for r in rules.ablations(ledger, [rules.BASE, rules.STRICT]).collect()}
    for policy in (rules.BASE, rules.STRICT):
        for rule in policy.rules:
            hits = [r.failed & policy.mask for r in rows]
            r = got[policy.name, rule]
            assert (r.n_rows, r.n_dropped) == (len(rows), sum(h != 0 for h in hits))
            assert (r.n_failing, r.n_only) == (sum(h & rules.BIT[rule] != 0 for h in hits), sum(h == rules.BIT[rule] for h in hits))
    kept = rules.apply_policy(ledger, rules.STRICT).where("kept").count()
    assert kept == sum(r.failed == 0 for r in rows)
    some = rules.common_failures(ledger).first()
    assert some.any_failed & rules.BIT["few_words"] and some.all_failed == 0


def test_empty_table(docs):
    assert rules.ledger(docs([])).count() == 0
    assert rules.ablations(rules.ledger(docs([])), [rules.BASE]).count() == 0
