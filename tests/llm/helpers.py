"""Small documents with the awkward cases, and brute-force versions of the operators."""

import base64
import random
import re

import public_tokenizers
import tiktoken

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tiktoken_encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def prose(rng, n):
    syllables = "the of and to in th er on an re nd ou éa ß ñ ing ion ble".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def documents(seed=1, n=60):
    """Rows with nulls in every column, empty and white texts, copies, near copies, shared passages and one long text."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    rows = []
    for i in range(n):
        text = prose(rng, rng.randint(1, 120))
        if i % 5 == 1:
            text = rows[-1][1]
        elif i % 5 == 2 and rows[-1][1]:
            words = rows[-1][1].split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif i % 5 == 3:
            text = f"{text}\n{passage}  {prose(rng, 5)}"
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
    rows += [(1000, None, "en", "src0", None), (1001, "", None, "src1", 0), (1002, " \n\t ", "en", None, 4), (1003, "one", "en", "src0", 3), (1004, "one", "en", "src0", 3)]
    rows += [(1005, "日本語" * 50 + "'s 12　x\x1cy <|endoftext|> \U0001f600", "de", "new", 170), (1006, prose(rng, 4000), "en", "src0", 0)]
    rows += [(None, rows[3][1], "en", "src1", 1), rows[7], rows[7]]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).repartition(3)
