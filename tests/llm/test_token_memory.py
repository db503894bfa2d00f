"""A task that writes token shards holds the arrays of a few MB of text at a time."""

import inspect
import tracemalloc

import public_tokenizers
import pyarrow as pa

from fieldloom.llm import token_store as T


def test_a_shard_of_long_texts_takes_little_memory(tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [f"the quick brown fox {i % 97} jumps over the lazy dog, " * 1200 for i in range(200)]  # 12 MB
    batch = pa.record_batch([pa.array(range(200), pa.int64()), pa.array(texts)], ["id", "text"])
    T.encoder(path)
    at_once = inspect.signature(T.write_tokens).parameters["batch_bytes"].default
    tracemalloc.start()
    try:
        (out,) = T._write_shard(iter([batch]), str(tmp_path), path, b"", 2, 3, at_once)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    print(f"peak {peak:.0f} MB")
    assert out.column(2).to_pylist() == [200] and peak < 80
