"""Documents with every awkward case, and columns whose names clash with those that operators use."""

import random

CLASHES = ["key", "text_", "th", "lines", "score", "ids", "class_id", "n_lines", "n_removed", "lang_pred", "ambiguous",
           "row", "starts", "body", "copy", "raw", "band", "part", "id", "url_", "cell", "row_of_id", "a.b", "nth"]


def words(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def awkward(spark, seed=1):
    """doc_id, text and clashing columns: nulls, empty, tiny, long, repeated and tied rows."""
    rnd = random.Random(seed)
    long = "\n".join(words(rnd, 40) + "." for _ in range(600))
    texts = [(0, ""), (1, None), (2, "one"), (2, "one"), (3, long), (None, words(rnd, 30)), (None, None),
             (4, words(rnd, 60)), (5, " \n\t  "), (6, "été Ünï ßtraße 漢字 👍🏽 don't I'LL 's"), (7, long + " tail"),
             (8, "1234 5678 !!!"), (9, "a\n\n\nb\n\n\nb"), (10, "x" * 3000), (11, words(rnd, 60)), (11, words(rnd, 61))]
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(k, t, *[f"v{i}" for i in range(len(CLASHES))]) for k, t in texts], schema)


def nothing(spark):
    return awkward(spark).limit(0)


def corpus(spark, n=120, seed=3):
    """Documents with copies, near copies, shared passages and shared lines."""
    rnd = random.Random(seed)
    passage = [words(rnd, 60, 5000) for _ in range(3)]
    rows, bodies = [], []
    for k in range(n):
        kind = rnd.randrange(6)
        if kind == 0 and bodies:
            body = rnd.choice(bodies)
        elif kind == 1 and bodies:
            own = rnd.choice(bodies).split(" ")
            for _ in range(max(1, len(own) // 60)):
                own[rnd.randrange(len(own))] = "edit"
            body = " ".join(own)
        else:
            body = "\n".join(words(rnd, rnd.randrange(5, 40), 3000) for _ in range(rnd.randrange(1, 8)))
            if kind == 2:
                body += " " + rnd.choice(passage) + " " + words(rnd, 4, 3000)
        bodies.append(body)
        rows.append((k * 3, body))
    return spark.createDataFrame(rows, "doc_id long, text string")
