import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

#: Hides one module, then imports the entry and names its queries.
PROBE = """
import sys
sys.modules[{hidden!r}] = None
sys.path.insert(0, {root!r})
import __spark_entry__ as e
print(*sorted(e.queries()))
"""


def registered(hidden: str) -> set[str]:
    out = subprocess.run([sys.executable, "-c", PROBE.format(hidden=hidden, root=ROOT)], capture_output=True, text=True, check=True)
    return set(out.stdout.split())


def test_entry_survives_a_missing_dependency_of_the_optional_part():
    names = registered("ahocorasick")
    assert "w1_post_sales_outcome" in names and not any(n.startswith("op") for n in names)


def test_entry_survives_a_missing_optional_part():
    assert registered("corpus_pipeline") == registered("ahocorasick")
