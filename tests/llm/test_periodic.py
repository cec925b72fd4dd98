import hashlib
import random
import zlib

from tests.llm.brute import WORD
from civisight.llm.periodic import periodic_runs, run_digests, tile_words


def brute_runs(words, least=6, times=4):
    out = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            run = words[start:i + q]
            if len(run) >= max(least, times * q) and not any(
                    all(run[x] == run[x + p] for x in range(len(run) - p)) for p in range(1, q)):
                out.append((start, len(run), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_tile(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def brute_row(doc_id, text):
    words = brute_tile(doc_id, WORD.findall(text or ""))
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def rows(seed=3):
    rng = random.Random(seed)
    out = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "a"), (1004, "a " * 6), (1005, "a " * 5), (1006, "É é É é É é É é"), (None, "x y " * 9)]
    out += [(1007, " ".join("ab"[bin(i).count("1") % 2] for i in range(600)))]  # no word thrice in a row with any period
    out += [(1008, ("w v " * 30_000)), (1008, "w v " * 4), (1008, "w v " * 4)]  # very long, repeated id, repeated row
    for i in range(300):
        n, letters = rng.randint(1, 80), rng.choice(["ab", "abc", "abcdefgh"])
        words = [rng.choice(letters) for _ in range(n)]
        if rng.random() < .7:
            unit = [rng.choice(letters) for _ in range(rng.randint(1, 12))]
            at = rng.randint(0, n)
            words[at:at] = (unit * 9)[:rng.randint(1, 9 * len(unit))]
        out.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    return out


def test_against_plain_version(spark):
    table = rows()
    docs = spark.createDataFrame([(i, t, [1], t) for i, t in table], "doc_id long, text string, runs array<int>, collapsed_text string")
    got = [tuple(r) for r in run_digests(periodic_runs(tile_words(docs))).collect()]
    assert got[0].__len__() == 8
    plain = [brute_row(i, t) for i, t in table if len(t or "") < 10_000]
    key = lambda r: tuple(str(x) for x in r)
    long = [r for r in got if r[3] is not None and r[3] > 10_000]
    assert sorted((r for r in got if r not in long), key=key) == sorted(plain, key=key)
    assert len(long) == 1 and long[0][1] >= 1


def test_long_periods(spark):
    rng = random.Random(8)
    unit = [f"w{rng.randrange(40)}" for _ in range(700)]
    words = ["begin"] + unit * 4 + unit[:13] + ["end"]
    found = periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert (1, 4 * 700 + 13, 700) in [tuple(r) for r in found.runs]
    assert found.collapsed_text == " ".join(["begin", *unit, "end"])


def test_no_rows(spark, nothing):
    assert run_digests(periodic_runs(tile_words(nothing))).collect() == []
