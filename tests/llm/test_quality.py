"""The byte-level network: held-out accuracy, whole texts, gradients."""

import zlib

import numpy as np

from tessella.llm import quality


def table(spark, name):
    return spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")


def test_held_out_accuracy(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    rows = quality.score(docs, quality.train(docs, labels)).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(p == y for p, y in held) / len(held) > 0.9
    assert sum(p for p, y in held if y) / sum(y for _, y in held) > 0.97


def test_edge_cases(spark, docs, no_docs):
    net = quality.fit([])
    rows = quality.score(docs, net).collect()
    assert len(rows) == docs.count() and {r.score for r in rows if r.doc_id in (1, 2)} == {net.score(b"")}
    assert quality.score(no_docs, net).count() == 0
    assert quality.keep_good(docs, net, threshold=0).count() == docs.count() and quality.keep_good(docs, net, threshold=1.1).count() == 0
    untrained = quality.train(docs, spark.createDataFrame([(None, 1), (5, None)], "doc_id long, quality int"))
    assert untrained.score(b"x") == net.score(b"x")


def plain_score(net, text):
    n = max(1, -(-len(text) // quality.CHUNK))
    data = text + bytes(n * quality.CHUNK + quality.WIDTH - len(text))
    pooled = np.array([[max(0.0, max(sum(float(net.tables[k, data[c * quality.CHUNK + s + k], f]) for k in range(quality.WIDTH)) for s in range(quality.CHUNK)) + float(net.bias[f])) for f in range(quality.FILTERS)] for c in range(n)])
    z = net.combine[0] @ pooled.mean(axis=0) + net.combine[1] @ pooled.max(axis=0) + net.combine[2] @ pooled.min(axis=0) + net.shift
    return 1 / (1 + np.exp(-z))


def test_scores_equal_a_plain_network(monkeypatch):
    net = quality.Network(3)
    text = bytes(np.random.default_rng(1).integers(1, 256, 700, np.uint8))
    wanted = plain_score(net, text)
    assert abs(net.score(text) - wanted) < 1e-4
    monkeypatch.setattr(quality, "STEP", 256)
    assert abs(net.score(text) - wanted) < 1e-4


def test_gradients_equal_differences():
    net = quality.Network(4)
    chunks, y = quality.chunks_of(b"Some text that fills more than one chunk. " * 12), 1
    grads = [np.zeros(p.shape) for p in net.params()]
    quality._backward(net, chunks, y, grads)

    def loss():
        z = np.maximum(np.stack([sum(net.tables[k].astype(float)[c[np.arange(quality.CHUNK) + k]] for k in range(quality.WIDTH)).max(axis=0) for c in chunks]) + net.bias, 0)
        return np.log1p(np.exp(-net.combined(z)))

    for part, grad in ((net.tables, grads[0]), (net.combine, grads[2])):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        kept, part[at] = part[at], part[at] + 1e-3
        up = loss()
        part[at] = kept - 1e-3
        down = loss()
        part[at] = kept
        assert abs((up - down) / 2e-3 - grad[at]) < 0.05 * abs(grad[at]) + 1e-3


def test_training_reads_whole_texts(monkeypatch):
    text = b"ab " * 10000
    n = -(-len(text) // quality.CHUNK)
    start = quality.Network(9).tables[:, ord("~")]
    for c in range(n):  # a mark that only one chunk has
        at = c * quality.CHUNK + 100
        marked = text[:at] + b"~" * 12 + text[at + 12 :]
        chunks = quality.chunks_of(marked)
        assert len(chunks) == n and (chunks[c] == ord("~")).any()
    monkeypatch.setattr(quality, "EPOCHS", 1)
    assert (quality.fit([(chunks, 1)]).tables[:, ord("~")] != start).any()
    got = []
    for slab in (1, 7, 1000):
        monkeypatch.setattr(quality, "SLAB", slab)
        got.append([np.zeros(p.shape) for p in quality.Network(4).params()])
        quality._backward(quality.Network(4), chunks, 1, got[-1])
    assert all(np.allclose(a, b) for other in got[1:] for a, b in zip(got[0], other, strict=True))
