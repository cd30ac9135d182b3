from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.llm import quality, queries


def plain_repeats(words):
    places = defaultdict(list)
    for i in range(len(words) - 4):
        places[tuple(words[i : i + 5])].append(i)
    return len({j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 5)})


def plain(text):
    text = text or ""
    words = "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ")
    words = [w for w in words if w]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    repeat = plain_repeats(words)
    failed = len(words) < 10 or 100 * repeat > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, repeat, failed


def test_base_counts_against_plain_python(spark, docs, edge_docs):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    rows = docs.select("doc_id", "text").unionAll(edge_docs.select("doc_id", "text"))
    for r in rows.withColumn("q", quality.quality(F.col("text"))).collect():
        assert tuple(r["q"][n] for n in names) == plain(r["text"])
        assert not (r["q"]["base_failed"] and r["q"]["kept"])


def test_no_rows(no_docs):
    assert no_docs.select(quality.quality(F.col("text"))).count() == 0


def test_fluent_text_of_many_scripts_stays_and_noise_goes():
    import random
    import public_tokenizers

    path, rng = public_tokenizers.path(quality.VOCABULARY), random.Random(1)
    fluent = [
        "Every happy household resembles its neighbours, while unhappy ones, as the novelist wrote, suffer each in their own way.",
        "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по своему, как говорят.",
        "Όλες οι ευτυχισμένες οικογένειες μοιάζουν μεταξύ τους αλλά κάθε δυστυχισμένη είναι δυστυχισμένη αλλιώς",
    ]
    assert all(quality.measure(t, path)[-1] for t in fluent)
    bytes_only = " ".join("".join(chr(rng.randrange(0xE000, 0xF000)) for _ in range(8)) + "a" * 9 for _ in range(40))
    assert not quality.measure(bytes_only, path)[-1]
    assert not quality.measure(" ".join(f"{'ab' * 3000}{i}" for i in range(12)), path)[-1]


@pytest.mark.parametrize(("text", "script"), [("Straße", "latin"), ("123", "other"), ("漢字 a", "han"), ("", "other")])
def test_script(text, script):
    assert quality.script_of(text) == script


def test_query_keeps_most_documents(spark):
    rows = queries.op7_quality_rules(spark, "/root/testdata/sf0.001").collect()
    assert all(r["kept"] != r["base_failed"] for r in rows)


def test_noise_is_rejected_and_fluent_text_of_more_scripts_stays():
    import random
    import string

    import public_tokenizers

    path, rng = public_tokenizers.path(quality.VOCABULARY), random.Random(7)
    alphabets = {
        "letters": string.ascii_lowercase, "capitals": string.ascii_uppercase, "digits": string.digits,
        "base64": string.ascii_letters + string.digits + "+/", "signs": string.punctuation,
        "signs and a letter": string.punctuation, "private": [chr(c) for c in range(0xE000, 0xF000)],
        "cyrillic": [chr(c) for c in range(0x430, 0x450)], "hangul": [chr(c) for c in range(0xAC00, 0xD7A4)],
    }
    for name, alphabet in alphabets.items():
        for n_words in (30, 100, 400):
            words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(4, 9))) for _ in range(n_words)]
            text = " ".join(words + ["\u03b1"] * (name == "signs and a letter"))
            assert not quality.measure(text, path)[-1], (name, n_words)
    for text in (
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem.",
        "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi của mình.",
        "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았다.",
        "ყველა ადამიანი იბადება თავისუფალი და თანასწორი თავისი ღირსებითა და უფლებებით. მათ მინიჭებული აქვთ გონება.",
        "यह एक साधारण वाक्य है जिसमें कई शब्द हैं और जो हिन्दी में लिखा गया है ताकि जाँच हो सके।",
    ):
        assert quality.measure(text, path)[-1], text


def test_fertility_and_verdict_against_plain_python(spark, docs):
    import math
    from collections import Counter

    import public_tokenizers
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(quality.VOCABULARY))
    for r in docs.withColumn("q", quality.quality(F.col("text"))).collect():
        text, q = r["text"] or "", r["q"]
        ids = pieces.encode(text)
        counts = Counter(ids)
        entropy = sum(-n / len(ids) * math.log2(n / len(ids)) for n in counts.values())
        chars = sum(c not in " \t\n\x0b\x0c\r" for c in text)
        per_token = chars / max(1, len(ids))
        byte_share = sum(pieces.is_byte(i) for i in ids) / max(1, len(ids))
        assert q["n_tokens"] == len(ids) and math.isclose(q["token_entropy"], entropy, abs_tol=1e-9)
        assert math.isclose(q["chars_per_token"], per_token) and math.isclose(q["byte_share"], byte_share)
        letters = [c for c in text if c.isalpha()]
        marked = sum(ord(c) > 127 for c in letters) > quality.MARKED_SHARE * len(letters)
        assert q["script"] == ("latin" if letters else "other")
        band = quality.BANDS["latin_marked" if marked else "latin"]
        fits = bool(letters) and len(letters) >= quality.MIN_LETTER_SHARE * chars
        fits = fits and band.min_chars <= per_token <= band.max_chars and byte_share <= band.max_byte_share
        if len(ids) >= quality.MIN_TOKENS_FOR_ENTROPY:
            fits = fits and band.min_entropy <= entropy <= band.max_bits * per_token
        assert q["kept"] == (fits and not q["base_failed"])
