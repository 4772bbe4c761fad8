import hashlib
import zipfile
import zlib

import pytest
from quern.llm import media as M
from quern.llm.common import remote


def expected(text):
    raw = (text or "").encode()
    p = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
    return len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])


def test_store_and_read_back(spark, awkward, awkward_rows, empty):
    at = M.store(awkward)
    got = M.described(M.load(spark, at, range_bytes=3000)).collect()
    want = sorted((str(d), *expected(t)) for d, t, _, _ in awkward_rows)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    forms = {}
    for r in got:
        assert forms.setdefault(r["payload_sha256"], (r["media_bytes"], r["media_sha256"], r["feature"])) == (r["media_bytes"], r["media_sha256"], r["feature"])
    assert M.load(spark, M.store(empty)).collect() == []


def test_png_is_lossless_and_checked():
    samples = bytes(range(256)) * 9
    image = M.to_png(samples)
    assert M.from_png(image) == samples and image.startswith(b"\x89PNG")
    with pytest.raises(ValueError):
        M.from_png(image[:60] + bytes([image[60] ^ 1]) + image[61:])


def test_members_are_retried_by_offset(tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for k in range(3):
            z.writestr(f"{k:08d}_{k}.png", M.to_png(M.payload(f"text {k}")))
    fs, path = remote(str(tmp_path / "a.zip"))
    infos = M.directory(fs, path)
    failures = {infos[1].header_offset: 2}

    class Flaky:
        opened = 0

        def open_input_file(self, p):
            Flaky.opened += 1
            f = fs.open_input_file(p)
            seek = f.seek

            class File:
                def __enter__(self):
                    return self

                def __exit__(self, *a):
                    f.close()

                def seek(self, at):
                    if failures.get(at, 0) > 0:
                        failures[at] -= 1
                        raise OSError("lost connection")
                    return seek(at)

                def read(self, n):
                    return f.read(n)

            return File()

    got = [M.from_png(M.member(Flaky(), path, i)).rstrip(b"\xff") for i in infos]
    assert got == [b"text 0", b"text 1", b"text 2"] and Flaky.opened == 5
    failures[infos[2].header_offset] = 99
    with pytest.raises(OSError):
        M.member(Flaky(), path, infos[2])
