import random
import re
from collections import Counter, defaultdict

from tests.llm.brute import WORD, ascii_lower
from civisight.llm.quality_rules import quality_rules


def norm(line):
    return re.sub(r"[ \t\x0b\f\r]+", " ", re.sub("[1-9]", "0", ascii_lower(line))).strip(" ")


def brute(rows, floor=10, share=5, min_words=50):
    held, all_texts = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        all_texts[host].add(text or "")
        for line in (text or "").split("\n"):
            if norm(line):
                held[host, norm(line)].add(text or "")
    high = {k for k, v in held.items() if len(v) > floor and 100 * len(v) > share * len(all_texts[k[0]])}
    out = []
    for doc_id, text, host in rows:
        text = text or ""
        words = WORD.findall(text)
        grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        count = Counter(grams)
        again = {q for i, g in enumerate(grams) if count[g] > 1 for q in range(i, i + 3)}
        lines = text.split("\n")
        full = [x for x in lines if WORD.search(x)]
        gone = [i for i, x in enumerate(lines) if norm(x) and (host, norm(x)) in high]
        lost = sum(len(norm(lines[i]).split(" ")) for i in gone)
        failed = len(words) < min_words or 100 * len(again) > 50 * len(words)
        kept = not failed and len(words) - lost >= min_words and 2 * lost <= len(words)
        body = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out.append((doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)),
                    len(again), failed, len(gone), lost, kept, body))
    return out


def table():
    rng = random.Random(4)
    say = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))
    menu, notice = say(30), "Page 12 of 90"
    rows = [(1000, None, "a"), (1001, "", None), (1002, " \n\t \n", "a"), (None, say(60), "b"), (1003, "$$ ## x | <y>\n" * 3, "b"), (1004, say(3) + " " + say(30_000), "a")]
    copy = say(70)
    rows += [(i, copy, "a") for i in range(100, 140)]  # exact copies: no line of theirs becomes frequent
    for i in range(200):
        body = [say(rng.randint(1, 40)) for _ in range(rng.randint(1, 5))]
        if i % 3 == 0:
            body.insert(rng.randint(0, len(body)), "  " + menu.upper().replace(" ", " \t"))
        if i % 4 == 0:
            body.append(notice.replace("12", str(i % 7 + 10)))
        if i % 10 == 0:
            body += ["", body[0], body[0]]
        rows.append((i, "\n".join(body), ["a", "b", None][i % 3 if i % 2 else 0]))
    return rows + rows[-1:]


def test_against_plain_version(spark):
    rows = table()
    docs = spark.createDataFrame([(i, t, h, h, [1], t) for i, t, h in rows], "doc_id long, text string, source string, host string, lines array<int>, key string")
    got = [tuple(r) for r in quality_rules(docs, texts=True).collect()]
    key = lambda r: tuple(str(x) for x in r)
    want = brute(rows)
    assert any(r[9] for r in want) and any(not r[6] and not r[9] for r in want) and any(r[8] for r in want if r[9])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_no_rows(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
