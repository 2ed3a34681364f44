"""Tests of this folder may import each other's helpers."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
