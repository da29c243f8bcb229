"""A task that goes on after its job was aborted leaves nothing behind."""

import os

import pytest
from pyspark.sql import Row

from crawlsift.sinks.documents import DocumentWriter


def test_an_attempt_after_the_abort_finds_no_folder(tmp_path):
    path = str(tmp_path / "out")
    writer = DocumentWriter(path, False)
    writer.abort([])
    with pytest.raises(OSError):
        writer.write(iter([Row(name="a.md", text="a")]))
    assert not os.listdir(f"{path}/_attempts")
