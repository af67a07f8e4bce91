"""Lets the pipeline's tests use the brute-force versions of the other tests."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
