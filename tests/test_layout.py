"""The training-data operators are a leaf: nothing else imports them."""

import os
import re

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def sources(*skip):
    for folder, _, names in os.walk(os.path.join(ROOT, "sparkgrams")):
        for name in names:
            path = os.path.join(folder, name)
            if name.endswith(".py") and not any(f"{os.sep}{s}{os.sep}" in path for s in skip):
                with open(path, encoding="utf-8") as f:
                    yield path, f.read()


def test_nothing_imports_the_llm_subpackage():
    bad = [p for p, text in sources("llm") if re.search(r"^\s*(from|import)\s+\S*llm", text, re.M)]
    assert not bad


def test_no_local_checkpoint_and_no_rdd_code():
    assert not [p for p, text in sources() if "localCheckpoint" in text or ".rdd" in text]
