import pytest

pytest.importorskip("larkline.llm")
