import random
from collections import Counter

from auditloom.llm.quality import clean_documents, quality_labels, repeated_words
from tests.llm.odd import frame, odd_rows, prose, words_of


def line_norm(words):
    return b" ".join(words).lower().translate(bytes.maketrans(b"123456789", b"0" * 9))


def brute_force(rows, max_docs=50, left=30):
    docs_with = Counter()
    for row in rows:
        for key in {line_norm(line.encode().split()) for line in (row[1] or "").split("\n") if line.encode().split()}:
            docs_with[row[3], key] += 1
    out = []
    for doc_id, text, _, host, _ in rows:
        words = words_of(text)
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [line for line in (text or "").split("\n") if line.encode().split()]
        lost = sum(len(line.encode().split()) for line in lines if docs_with[host, line_norm(line.encode().split())] > max_docs)
        n = len(words)
        failed = n < 50 or 100 * len(covered) > 50 * n
        out.append(
            (
                doc_id, n, sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""),
                len(lines) - len(set(lines)), len(covered), lost, failed, not failed and not (n - lost) * 100 < n * left,
            )
        )
    return out


def host_rows(rng):
    """A host whose documents share lines, one with nothing else, and the same lines at another host."""
    shared = [prose(rng, 12) for _ in range(8)]
    rows = []
    for i in range(60):
        lines = rng.sample(shared, 3) + [prose(rng, 40) for _ in range(rng.randrange(1, 4))]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), "en", "hot" if i < 40 else "cold", 1))
    rows.append((100, "\n".join(shared), "en", "hot", 1))
    rows.append((101, "\n".join(shared), "en", "cold", 1))
    rows.append((102, "\n".join(line.upper().replace(" ", "  ") for line in shared), "en", None, 1))
    return rows


def check(spark, rows, clash=False, max_docs=50):
    got = quality_labels(frame(spark, rows, clash), max_docs=max_docs).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute_force(rows, max_docs))
    return got


def test_odd_documents_equal_brute_force(spark):
    check(spark, odd_rows(), clash=True)
    check(spark, odd_rows(), max_docs=1)


def test_frequent_lines_of_a_host(spark):
    got = {r.doc_id: r for r in check(spark, host_rows(random.Random(2)), max_docs=8)}
    assert not got[100].kept and not got[100].base_failed and got[101].kept


def test_cleaned_documents_lose_frequent_lines_only(spark):
    rows = host_rows(random.Random(2))
    docs = frame(spark, rows, clash=True)
    cleaned = clean_documents(docs, max_docs=8)
    assert cleaned.columns == docs.columns
    verdicts = {b[0]: b for b in brute_force(rows, 8)}
    texts = {r.doc_id: r.text for r in cleaned.collect()}
    assert set(texts) == {i for i, b in verdicts.items() if b[8]}
    original = {r[0]: r[1] for r in rows}
    for i, text in texts.items():
        kept = text.split("\n")
        assert len(words_of(text)) == verdicts[i][1] - verdicts[i][6]
        assert [line for line in original[i].split("\n") if line in kept] == kept


def test_repeated_words_of_long_texts():
    rng = random.Random(1)
    words = [rng.choice([b"a", b"b", b"c"]) for _ in range(300)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(298) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    assert repeated_words(words) == len(covered)
    many = [b"%d" % i for i in range(2**20 + 5)]
    assert repeated_words(many) == 0 and repeated_words(many + many[:3]) == 6


def test_empty_table(spark):
    assert quality_labels(frame(spark, [])).count() == 0
    assert clean_documents(frame(spark, [])).count() == 0
