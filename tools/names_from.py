"""Print registered query names from a given one on."""
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from scorewright.plans.catalog import load  # noqa: E402

names = list(load()[0])
print(*names[names.index(sys.argv[1]):])
