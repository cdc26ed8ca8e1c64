"""A small corpus with copies, near copies, shared passages, nulls, repeated rows and clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mix_size long, rep_key string, n_bytes long, kept boolean"


def texts(seed=1, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgéö") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    weights = [1 / (k + 1) for k in range(300)]

    def prose(k):
        return " ".join(rng.choices(words, weights, k=k))

    passage = prose(60)
    out = []
    for i in range(n):
        if i % 10 == 7 and i > 10:
            out.append(out[i - 7])  # a copy
        elif i % 10 == 8 and i > 10:
            near = out[i - 6].split(" ")
            if len(near) > 4:
                near[len(near) // 2] = "CHANGED"
            out.append(" ".join(near))
        elif i % 10 == 3:
            out.append(prose(30) + "\n" + passage + "\n" + prose(25))
        else:
            out.append(prose(rng.choice([3, 55, 80, 200])).capitalize() + rng.choice(["", "\n", "  \t", "\r\nend."]))
    return out


def rows(seed=1, n=60):
    out = [(i, t, "en", f"src{i % 4}", len(t), -1, "x", -2, False) for i, t in enumerate(texts(seed, n))]
    long_text = " ".join(texts(seed + 1, 40)) * 3
    extra = [(n, None, None, None, None, None, None, None, None), (n + 1, "", "en", "src1", 0, 1, "", 1, True),
             (n + 2, " \n\t ", "en", None, 4, 1, "", 1, True), (None, out[5][1], "en", "src2", 1, 1, "", 1, True),
             (None, None, None, None, None, None, None, None, None), (n + 3, long_text, "en", "src3", len(long_text), 1, "", 1, True),
             (n + 4, "one", "en", "src0", 3, 1, "", 1, True), (n + 5, "one", "en", "src0", 3, 1, "", 1, True), out[9], out[9]]
    return out + extra


def documents(spark, seed=1, n=60):
    return spark.createDataFrame(rows(seed, n), SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    """Words ``[^\\x20\\x09-\\x0D]+``, as bytes.split() finds them."""
    return [w.decode() for w in (t or "").encode().split()]
