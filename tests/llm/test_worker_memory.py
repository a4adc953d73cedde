"""What a Python worker still holds when its tasks are over."""

import os
import subprocess
import sys

import pytest

TASKS = """
import random
import pyarrow as pa
from roadloom.llm import token_files
from roadloom.llm.textbytes import released

def held():
    lines = open("/proc/self/smaps_rollup").read().splitlines()
    return sum(int(x.split()[1]) for x in lines if x.startswith("Pss_Anon:")) / 1024

rng = random.Random(4)
words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 10))) for _ in range(40_000)]
batch = pa.record_batch([pa.array(range(1500)), pa.array([" ".join(rng.choices(words, k=500)) for _ in range(1500)])], names=["doc_id", "text"])
step = token_files._encode_batches(token_files.default_tokenizer(), 0, keep=False)
after = []
for _ in range(5):
    for _ in released(step)([batch]):
        pass
    after.append(held())
print(*after)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory can't be read here")
def test_encoding_tasks_leave_no_more_memory_each_time():
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"} | {"RAYON_NUM_THREADS": "8"}
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    said = subprocess.run([sys.executable, "-c", TASKS], env=env, cwd=root, capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr[-2000:]
    after = [float(x) for x in said.stdout.split()]
    assert after[-1] - after[0] < 20, after
