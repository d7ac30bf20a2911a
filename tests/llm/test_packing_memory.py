"""What a worker of the packing stage holds: an executor has one for each core, beside a heap that earlier stages have filled."""

import subprocess
import sys

PROBE = """
import resource, sys
import public_tokenizers
from ledgerloom.llm import packing
encode = packing.Ids(public_tokenizers.path("byte_bpe_50k.json"))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = 0
while n < 900_000:
    texts, size = [], 0
    while size < packing.CHARACTERS:
        texts.append(" ".join(f"w{k * 7919 % 1000003}" for k in range(n, n + 400)))
        n, size = n + 400, size + len(texts[-1])
    encode.batch(texts)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_ids_of_many_words_take_little_memory():
    said = subprocess.run([sys.executable, "-c", PROBE], capture_output=True, text=True, check=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert int(said.stdout) < 180
