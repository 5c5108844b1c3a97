"""Small corpora with the cases that operators must bear."""

import random
import tempfile

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = [" ", "  ", "\n", "\t", " \r\n", "\x0b"]


def documents(n=60, seed=1):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Größe", "naïve", "x", "12", "a,b", "don't", "日本", "###", " nbsp ", "é", "<|endoftext|>", "😀"] + [f"w{i}" for i in range(40)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(90))
    texts = [None, "", " \n\t ", "one", "two words", "aaaa " * 300, "ab" * 900, passage, passage, passage + " end"]
    while len(texts) < n:
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 120, 400]))]
        if rng.random() < 0.3:
            at = rng.randrange(len(words))
            words[at:at] = [passage]
        text = "".join(w + rng.choice(SPACES) for w in words)
        texts.append(text)
        if rng.random() < 0.2:
            texts.append(text)
        if rng.random() < 0.1:
            texts.append(text.replace("w7", "w8"))
    rows = [(i, t, "en", rng.choice(["a", "a", "a", "b", None]), None if t is None else len(t)) for i, t in enumerate(texts[:n])]
    rows.append(rows[7])  # a repeated row
    rows.append((None, texts[20], "en", "b", 1))
    rows.append((None, texts[20], "en", "b", 1))
    return rows


def frame(spark, rows=None, extra=False, partitions=3):
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(partitions)
    if extra:
        from pyspark.sql import functions as F

        for c in ("row", "size", "h", "fp", "target", "length", "label_id", "document", "component"):
            df = df.withColumn(c, F.lit("clash"))
    path = tempfile.mkdtemp() + "/docs"  # operators that read their input twice need it stored
    df.write.parquet(path)
    return spark.read.parquet(path)
