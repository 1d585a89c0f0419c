import random
import re

from pyspark.sql import functions as F

from matchlake.llm import line_dedup as L
from tests.llm.helpers import documents, odd_rows, words as any_words


def words(seed, n):
    return [w.translate(str.maketrans("0123456789", "ghijklmnop")) for w in any_words(seed, n)]


def kept(spark, rows, **options):
    return {r.doc_id: r.text for r in L.dedup_lines(documents(spark, rows), **options).collect()}


def test_recurring_lines_stay_in_their_first_document(spark):
    rows = [(i, f"own {' '.join(words(i, 9))}\nAll rights reserved.\n\nlast {i}") for i in range(7, 0, -1)]
    got = kept(spark, rows)
    assert "All rights reserved." in got[1]
    assert all("All rights reserved." not in got[i] for i in range(2, 8)) and all(f"own {' '.join(words(i, 9))}" in got[i] for i in got)
    assert "last 1" in got[1] and "last" not in got[3]  # a number is a variable field
    assert kept(spark, rows[:4]) == dict(rows[:4])


def test_variable_fields_and_open_quarters(spark):
    line = "2024-01-0{} 12:0{}:11 connection from host {} closed by the peer after timeout".format
    rows = [(i, f"{line(i, i, 'abcdefg'[i])}\n" + " ".join(words(i, 12))) for i in range(6)]
    got = kept(spark, rows)
    assert "connection" in got[0] and all("connection" not in got[i] for i in range(1, 6))
    assert all(" ".join(words(i, 12)) in got[i] for i in range(6))


def test_lines_repeated_inside_one_document_do_not_count(spark):
    rows = [(1, "again and again\n" * 9), (2, "again and again\nx")]
    assert kept(spark, rows, min_docs=3) == dict(rows)
    got = L.dedup_lines(documents(spark, rows), min_docs=2).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped) for r in got} == {1: (10, 0), 2: (2, 1)}


def test_odd_rows(spark):
    docs = odd_rows(spark)
    got = L.dedup_lines(docs)
    assert got.columns == docs.columns + ["n_lines", "n_dropped"]
    assert sorted(str(r.text) for r in got.collect()) == sorted(str(r.text) for r in docs.collect())
    assert L.dedup_lines(docs.limit(0)).count() == 0
    same = documents(spark, [(None, "one line here"), (1, "one line here"), (1, "one line here"), (2, "one line here")])
    assert sorted((r.doc_id or 0, r.text) for r in L.dedup_lines(same, min_docs=2).collect()) == [
        (0, ""), (1, "one line here"), (1, "one line here"), (2, "")]


def test_rows_of_numbers_are_content(spark):
    rows = [(i, f"{i} {i * i} 7{i}\n1 2 3 4 5 6 7 8 9 {i}") for i in range(9)]
    assert kept(spark, rows) == dict(rows)


def test_mostly_variable_lines_are_generalised(spark):
    rows = [(i, f"2024-01-0{i} 10:00:0{i} GET /x/{i} 20{i} 51{i}\n" + " ".join(words(i, 12))) for i in range(8)]
    got = kept(spark, rows)
    assert "GET" in got[0] and all("GET" not in got[i] and " ".join(words(i, 12)) in got[i] for i in range(1, 8))


def test_long_lines_need_two_documents_only(spark):
    shared, short = " ".join(words(99, 60)), " ".join(words(98, 19))
    rows = [(i, f"{shared}\n{short}\n" + " ".join(words(i, 15))) for i in range(3)]
    got = kept(spark, rows)
    assert shared in got[0] and shared not in got[1] and shared not in got[2]
    assert all(short in got[i] and " ".join(words(i, 15)) in got[i] for i in range(3))


def brute(rows):
    """Dropped lines of each row, from the rules written out with strings."""
    keys, seen = {}, {}
    for at, (doc, text) in enumerate(rows):
        for i, line in enumerate((text or "").split("\n")):
            t = ["<*>" if any(c in "0123456789" for c in w) else w for w in re.split("[\t-\r ]+", line) if w]
            n = len(t)
            shapes = [("own", tuple(t))] if n else []
            if n >= 8:
                edge = [2 + (n - 2) * q // 4 for q in range(5)]
                shapes += [(q, tuple(t[: edge[q]]), tuple(t[edge[q + 1] :])) for q in range(4)]
            for shape in shapes:
                said = sum(w != "<*>" for part in shape[1:] for w in part)
                if said:
                    keys.setdefault((at, i), []).append((n, shape, said))
                    seen.setdefault((n, shape), set()).add(doc)
    return {
        at: sum(
            any(len(seen[n, s]) >= (2 if said >= 20 else 5) and min(seen[n, s]) != doc for n, s, said in keys.get((at, i), []))
            for i in range(len((text or "").split("\n")))
        )
        for at, (doc, text) in enumerate(rows)
    }


def test_against_brute_force(spark):
    r = random.Random(4)
    rows = []
    for doc in range(60):
        lines = []
        for _ in range(r.randrange(1, 8)):
            line = words(r.randrange(12), r.choice([1, 3, 8, 9, 22, 23, 40]))
            for _ in range(r.choice([0, 0, 1, 3])):
                line[r.randrange(len(line))] = r.choice(["7", "x9", "other", "<*>"])
            lines.append(r.choice([" ", "\t", "  "]).join(line))
        rows.append((doc, "\n".join(lines)))
    got = {x.doc_id: x.n_dropped for x in L.dedup_lines(documents(spark, rows)).collect()}
    assert got == brute(rows) and sum(got.values()) > 30


def test_clashing_names(spark):
    docs = documents(spark, [(i, "one line here again") for i in range(6)])
    for c in ("_drop", "_drop_id", "_drop_digest", "_lines", "n_lines", "n_dropped", "__drop"):
        docs = docs.withColumn(c, F.lit("theirs"))
    got = L.dedup_lines(docs).collect()
    assert sorted(r.n_dropped for r in got) == [0, 1, 1, 1, 1, 1] and {r["_drop"] for r in got} == {"theirs"}
