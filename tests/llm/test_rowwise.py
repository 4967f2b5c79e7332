"""Operators that work row by row, against the libraries or plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tessella.llm import chat, decontaminate, media, secrets, token_counts

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_token_counts_equal_the_library(docs, no_docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    wanted = Counter((i, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in texts)
    assert rows_of(token_counts.count_tokens(docs, path), "doc_id", "n_bytes", "n_tokens") == wanted
    assert token_counts.count_tokens(no_docs, path).count() == 0


def test_whole_tokens_are_proved_by_the_library():
    data = open(public_tokenizers.path("word_bpe_49k.json"), "rb").read()
    counter = token_counts.Counter(data)
    assert len(counter.whole) > 20_000
    counter.memo = {}
    assert all(counter.merge(w) == 1 for w in sorted(counter.whole)[::97])


def test_media_round_trip_and_digests(docs, no_docs):
    wanted = Counter()
    for r in docs.collect():
        text = (r.text or "").encode()
        payload = text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))
        wanted[(r.doc_id, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))] += 1
    read = media.read_media(media.to_media(docs))
    assert rows_of(read, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == wanted
    assert media.read_media(media.to_media(no_docs)).count() == 0
    clips = media.clips(media.to_media(docs)).where("doc_id = 5").orderBy("clip").collect()
    assert clips[0].start_s == 0 and all(a.end_s == b.start_s for a, b in zip(clips, clips[1:]))


def test_every_difference_has_its_own_ten_bits():
    payload = bytes(np.random.default_rng(1).integers(0, 256, 64 * 40, np.uint8)) + bytes([0, 255] * 32)
    assert media.read_avi(media.write_avi(payload))[0] == payload
    assert len(set(media.ENCODE.tolist())) == 511


def test_frames_are_ordinary_jpeg():
    image = pytest.importorskip("PIL.Image")
    import io

    payload = bytes(range(256)) * 4
    frame = media.encode_frames(payload)[0][0]
    pixels = np.asarray(image.open(io.BytesIO(frame)))
    assert pixels[::8, ::8].ravel().tolist() == list(payload)


def test_shots_are_found_at_changes_of_level():
    rng = np.random.default_rng(2)
    still = lambda level: np.clip(rng.normal(level, 4, (20, 1024)), 0, 255).astype(np.uint8)
    assert media.shots(np.concatenate([still(40), still(200), still(100)])) == [(0, 20), (20, 40), (40, 60)]


def plain_secrets(text):
    found = []
    for kind, pattern, ok in (
        ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ):
        found += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text) if ok(m)]
    return sorted(found, key=lambda f: (f[0], ("assign", "access", "hex").index(f[2])))


def test_base_secrets(docs, no_docs):
    wanted = Counter()
    for r in docs.collect():
        spans = plain_secrets(r.text or "")
        wanted[(r.doc_id, *(sum(k == x for *_, k in spans) for x in ("assign", "access", "hex")), hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest())] += 1
    found = secrets.scan_secrets(docs)
    assert rows_of(found, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == wanted
    assert secrets.scan_secrets(no_docs).count() == 0


def test_battery_adds_random_tokens_and_leaves_words():
    import base64
    import random

    r = random.Random(5)
    keys = [base64.b64encode(r.randbytes(30)).decode() for _ in range(50)]
    got = [secrets.random_spans(f"see {k} here", []) for k in keys]
    assert sum(bool(g) for g in got) >= 45
    words = ["internationalisation_of_things", "thhetionthhetionthhetionthhetion", "a" * 40, "ABABABABABABABABABABABABAB", "-" * 60, "path/to/some/ordinary/file/name", "1234567890" * 3]
    assert not any(secrets.random_spans(w, []) for w in words)


def test_battery_takes_values_behind_an_equals_sign():
    import base64
    import random

    r = random.Random(6)
    for before, after in (("AWS_SECRET_ACCESS_KEY=", ""), ("SESSION=", ""), ("see https://x.example/a?sig=", "&n=1"), ("A=B=", " end"), ("==", "")):
        hits = 0
        for n in [30] * 20 + [31] * 20:  # without and with padding
            key = base64.b64encode(r.randbytes(n)).decode()
            alone, got = secrets.random_spans(key, []), secrets.random_spans(before + key + after, [])
            assert all((a, b) == (len(before), len(before) + len(key)) for a, b, *_ in got) and len(got) <= len(alone)
            hits += len(got)
        assert hits >= 36
    assert not any(secrets.random_spans(w, []) for w in ("internationalisation=of_things_and_others", "=" * 40, "name=" * 20, "AWS_SECRET_ACCESS_KEY=none"))


def plain_windows(text, items):
    words = WORD.findall(lower(text))
    hit, met = [False] * len(words), set()
    for key, item in items:
        w = WORD.findall(lower(item))
        n = min(10, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in windows:
                met.add(str(key))
                hit[i : i + n] = [True] * n
    return len(words), sum(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), any(hit)


def test_decontamination_equals_brute_force(spark, monkeypatch):
    import random

    r = random.Random(3)
    vocabulary = ["a", "b", "c", "dé", "e1"]
    items = [(k, " ".join(r.choice(vocabulary[: 2 + k % 4]) for _ in range(r.choice([0, 1, 3, 9, 10, 11, 12, 25])))) for k in range(40)] + [(40, None), (41, "a b. C"), (42, "a b c"), (10, "b a b")]
    texts = [(k, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 2, 15, 60, 300]))) + "; " + (items[r.randrange(40)][1] + "!") * (k % 2)) for k in range(60)] + [(60, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    wanted = Counter((k, *plain_windows(t, items)) for k, t in texts)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows_of(decontaminate.digest(decontaminate.match_items(docs, benchmark)), *columns) == wanted
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 40)
    assert rows_of(decontaminate.digest(decontaminate.match_items(docs, benchmark)), *columns) == wanted
    assert decontaminate.match_items(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_removes_spans_and_documents(spark):
    item = "one two three four five six seven eight nine ten eleven"
    long = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"{long}. {item}; tail", 0), (2, item, 0), (3, long, 0), (4, None, 0)], "doc_id long, text string, n_chars long")
    left = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert left == {1: f"{long}. ; tail", 3: long, 4: None}


def plain_chat(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    done = Counter()
    for conv, turns in out.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        done[(conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())] += 1
    return done


def test_chat_round_trip(spark, docs, monkeypatch):
    texts = [r.text for r in docs.collect()]
    rows = [(k % 7 if k % 5 else None, k // 7, ["user", "assistant", "system", None, "<s>[INST]\\"][k % 5], t) for k, t in enumerate(texts)] + [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, segment int")
    columns = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    formatted = chat.format_conversations(df)
    assert rows_of(chat.read_back(formatted, in_order=True), *columns) == plain_chat(rows)
    monkeypatch.setattr(chat, "SEGMENT", 8)
    assert rows_of(chat.read_back(chat.format_conversations(df)), *columns) == plain_chat(rows)
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_templates_fold_and_stay_in_the_sandbox():
    tree = chat.fold(chat.parse("a{{ 'b' + 'c' | upper }}{% if 1 == 2 %}x{% elif true %}d{% endif %}{{ n }}"))
    assert tree == [("text", "abCd"), ("out", ("name", "n"))]
    render = chat.compile_template("{% for m in messages %}{{ loop.index }}{% if not loop.last and m.role != 'x' %},{% endif %}{% endfor %}")
    assert "".join(p for p, _ in render(iter([{"role": "a"}, {"role": "x"}, {"role": "b"}]))) == "1,23"
    for bad in ("{{ m.__class__ }}", "{{ f() }}", "{{ m | pickle }}", "{% import os %}", "{% for m in messages %}", "{{ _x }}"):
        with pytest.raises(chat.TemplateError):
            chat.parse(bad)


def test_battery_finds_random_tokens_of_every_encoding_and_few_words():
    import random
    import string

    r = random.Random(11)
    words = ["the", "weather", "station", "reported", "morning", "against", "government", "history", "world", "people", "under", "between", "several", "of", "and", "in", "that", "with", "house", "from", "which"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    low, up, dig = string.ascii_lowercase, string.ascii_uppercase, string.digits
    for symbols in (low, up, dig + "ABCDEF", up + "234567", low + "234567", low + dig, up + dig, low + up + dig, low + up + dig + "+/", low + up + dig + "-_"):
        hits = 0
        for _ in range(60):
            before, key = prose(80) + " ", "".join(r.choice(symbols) for _ in range(40))
            hits += any(s[:2] == (len(before), len(before) + 40) for s in secrets.random_spans(before + key + " " + prose(20), []))
        assert hits >= 54, symbols
    false = 0
    for k in range(3000):
        parts = [r.choice(words) for _ in range(8)]
        token = ("".join(parts), "".join(p.title() for p in parts), "_".join(parts), "/".join(parts))[k % 4]
        false += bool(secrets.random_spans(prose(60) + " " + token, []))
    assert false <= 30


def test_a_long_text_full_of_spans_is_scanned_in_one_pass():
    import time

    text = "password=abcdefgh " * 30_000 + "x" * 30 + " word" * 100_000
    began = time.time()
    base = secrets.base_spans(text)
    assert len(base) == 30_000 and not secrets.random_spans(text, base) and time.time() - began < 10


def test_files_that_are_no_media_are_told_and_do_not_stop_the_rest(spark, docs):
    whole = [r for r in media.to_media(docs).collect() if r.doc_id in (4, 10)]
    rows = [(r.doc_id, r.n_bytes, bytes(r.media)) for r in whole] + [(90, 1, None), (91, 1, b""), (92, 1, b"RIFF and no more")] + [(93 + k, 1, bytes(whole[0].media)[:n]) for k, n in enumerate((11, 40, 300, len(whole[0].media) - 300))]
    got = {r.doc_id: r for r in media.read_media(spark.createDataFrame(rows, "doc_id bigint, n_bytes bigint, media binary")).collect()}
    assert len(got) == len(rows) and all(got[i].payload_bytes for i in (4, 10))
    assert all(got[k].payload_sha256 is None and got[k].feature.startswith("error=") and got[k].clips == [] for k in got if k >= 90)


def test_a_benchmark_of_many_shards_takes_several_passes(spark, docs, monkeypatch):
    from .conftest import invented

    items = spark.createDataFrame([(str(k), invented(k, 14)) for k in range(12)] + [("short", "same text twice"), (None, None)], "item_id string, text string")
    columns = ("doc_id", "n_words", "n_hit", "items")
    flat = lambda df: Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in df.select(*columns).collect())
    wanted, kept = flat(decontaminate.match_items(docs, items)), rows_of(decontaminate.decontaminate(docs, items), "doc_id", "text", "n_chars")
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 20)
    monkeypatch.setattr(decontaminate, "ROUND", 2)
    assert flat(decontaminate.match_items(docs, items)) == wanted and rows_of(decontaminate.decontaminate(docs, items), "doc_id", "text", "n_chars") == kept
