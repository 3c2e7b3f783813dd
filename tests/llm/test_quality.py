import random

from pyspark.sql import functions as F

from paraspark.llm.quality import quality_rules
from tests.llm.helpers import WORDS, docs, edge_texts, rows_by, sentence


def brute(text):
    words, lines = WORDS.findall(text or ""), (text or "").split("\n")
    seen, duplicates = set(), 0
    for line in lines:
        if WORDS.search(line):
            duplicates += line in seen
            seen.add(line)
    windows: dict = {}
    for k in range(len(words) - 7):
        windows.setdefault(tuple(words[k:k + 8]), []).append(k)
    repeated = {p for at in windows.values() if len(at) > 1 for k in at for p in range(k, k + 8)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), duplicates, len(repeated),
            n < 20 or 100 * len(repeated) > 30 * n)


def test_counts_match_brute_force(spark):
    rng = random.Random(8)
    texts = edge_texts()
    for _ in range(30):
        words = sentence(rng, rng.randint(1, 80))
        cut = rng.randint(0, len(words))
        texts.append(" ".join(words + words[cut:cut + 12]) + "\n" + " ".join(words[:3]) + "\n\n" + " ".join(words[:3]) + " #|<é")
    got = rows_by(quality_rules(docs(spark, texts)), "doc_id")
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(text), text
        assert not (r["kept"] and r["base_failed"])


def test_bands_reject_odd_texts_per_language_and_keep_clean_ones(spark):
    rng = random.Random(8)
    common = sentence(rng, 300)
    clean = [" ".join(rng.choice(common) for _ in range(rng.randint(80, 160))) for _ in range(400)]
    odd = [" ".join("Ω漢ж"[k % 3] * rng.randint(1, 3) for k in range(50)) for _ in range(5)]
    rare = [" ".join(chr(0x1F701 + rng.randint(0, 60)) for _ in range(70)) for _ in range(5)]   # byte fallback
    both = docs(spark, clean + odd + rare).union(docs(spark, [(1000 + k, t) for k, t in enumerate(odd)], lang=None))
    got = rows_by(quality_rules(both), "doc_id")
    assert all(got[i]["kept"] for i in range(400))
    assert not any(got[i]["kept"] for i in range(400, 410))
    # too few texts of the null language for a band
    assert all(got[1000 + k]["kept"] == (not got[1000 + k]["base_failed"]) for k in range(5))


def test_empty_table_and_extra_columns(spark):
    assert quality_rules(docs(spark, [])).count() == 0
    clash = docs(spark, ["a b"] * 2).withColumn("kept", F.lit(1)).withColumn("n_tokens", F.lit("x")).withColumn("id", F.lit(0))
    assert [r.base_failed for r in quality_rules(clash).collect()] == [True, True]
