import pytest

pytest.importorskip("turfspoor.llm")
