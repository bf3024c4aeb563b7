"""Small tables that hold the awkward cases every operator must survive."""

import random
import re

SPACE = "[\x20\x09-\x0d]"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def corpus(seed=0, size=60, vocabulary=40):
    """Rows (doc_id, text): nulls, empty texts, repeats, ties, copies, shared passages, long words."""
    draw = random.Random(seed)
    bag = ["".join(draw.choice("abcdeéßXYZñ") for _ in range(draw.randint(1, 9))) for _ in range(vocabulary)]
    passage = " ".join(draw.choice(bag) for _ in range(60))
    line = "A shared line, long enough"
    rows = []
    for i in range(size):
        body = [draw.choice(bag) for _ in range(draw.randint(0, 90))]
        text = "".join(w + draw.choice([" ", "  ", "\n", "\t", " \r\n"]) for w in body)
        if i % 7 == 0:
            text += "\n" + line.upper() + "\n" + passage
        if i % 11 == 0:
            text = passage + " " + text + "\n  " + line + "\t\n" + line
        rows.append((i * 3, text))
    rows += [(1, rows[5][1]), (2, rows[5][1].replace(" ", "")), (4, rows[7][1] + " more")]
    rows += [(5, None), (6, ""), (7, " \n\t "), (8, "x"), (8, "x"), (8, "other words of the same id"), (None, passage)]
    rows += [(None, None), (10, "w" * 5000 + " " + "w" * 5000), (11, passage), (11, passage), (-5, passage + " end")]
    draw.shuffle(rows)
    return rows


def frame(spark, rows, parts=3):
    """The rows as documents, with extra columns whose names clash with inner ones."""
    full = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows]
    df = spark.createDataFrame(full, SCHEMA).repartition(parts)
    clash = "block body text_hash key score n rank shard word node pos row domain digest keeper size label place slice"
    return df.selectExpr("*", *[f"'x' AS {name}" for name in [*clash.split(), "file", "line", "term"]])


def result(df, *names):
    found = df.select(*names).collect()
    return sorted((tuple(row) for row in found), key=repr)
