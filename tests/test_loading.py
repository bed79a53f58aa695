"""Inputs of every format, metadata by magic, coded pictures."""

import numpy as np
import pytest

from lumaframe.functions import kernels as K
from lumaframe.operators.codec import DeflateCodec
from lumaframe.operators.mux import MuxRequest, mux
from lumaframe.sources import carriers as M
from lumaframe.sources import images as S
from lumaframe.sources.loading import load_hdr, load_sdr, pq_to_linear


def pictures(spark, folder, codes):
    """The same picture as PNG, and a JPEG of one grey, written by the JVM."""
    jvm = spark.sparkContext._jvm
    io, file, image = jvm.javax.imageio.ImageIO, jvm.java.io.File, jvm.java.awt.image.BufferedImage
    h, w = codes.shape[:2]
    for name, kind in (("a.png", "png"), ("b.JPG", "jpg")):
        made = image(w, h, 1)
        for y in range(h):
            for x in range(w):
                r, g, b = (100, 100, 100) if kind == "jpg" else map(int, codes[y, x])
                made.setRGB(x, y, r << 16 | g << 8 | b)
        io.write(made, kind, file(str(folder / name)))


def test_every_format_as_light_and_codes(spark, tmp_path):
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 256, (60, 7, 3)).astype(np.uint8)
    pictures(spark, tmp_path, codes)
    values = rng.random((60, 7, 3))
    for bits in (8, 16, 32):
        (tmp_path / f"t{bits}.tif").write_bytes(S.write_tiff(7, 60, values.reshape(-1), bits))
    (tmp_path / "broken.tif").write_bytes(b"II*\0")
    (tmp_path / "broken.png").write_bytes(b"nothing")
    (tmp_path / "c.dng").write_bytes(b"II*\0")
    paths = [str(tmp_path)]

    def whole(rows, columns):
        out = {}
        for r in sorted(rows, key=lambda r: r["y0"] or 0):
            name = r["path"].rsplit("/", 1)[1]
            if r["error"]:
                out[name] = r["error"].split(":")[0]
            else:
                part = np.frombuffer(r["base"], np.uint8).reshape(r["height"], r["width"], 3) if columns == "base" else np.stack([np.frombuffer(r[c]) for c in "rgb"], axis=1).reshape(r["height"], r["width"], 3)
                out[name] = np.concatenate([out[name], part]) if name in out else part
        return out

    light, sdr = whole(load_hdr(spark, paths).collect(), "rgb"), whole(load_sdr(spark, paths).collect(), "base")
    for found in (light, sdr):
        assert found["broken.tif"] in ("ValueError", "KeyError", "error") and found["broken.png"] == "ValueError" and found["c.dng"] == "UnsupportedInput"
    assert np.array_equal(light["a.png"], K.LINEAR[codes]) and np.array_equal(sdr["a.png"], codes)
    assert np.abs(sdr["b.JPG"].astype(int) - 100).max() <= 2 and light["b.JPG"].shape == (60, 7, 3)
    assert np.allclose(light["t32.tif"], values.astype(np.float32)) and np.allclose(light["t8.tif"], K.LINEAR[np.rint(values * 255).astype(int)])
    assert np.allclose(light["t16.tif"], pq_to_linear(np.rint(values * 65535) / 65535, 203.0))
    assert np.abs(sdr["t16.tif"] / 255 - values).max() < 0.003 and np.abs(sdr["t32.tif"] / 255 - values).max() < 0.003


def test_pq_ends():
    assert abs(pq_to_linear(np.array([0.0]), 1.0)[0]) < 1e-6 and abs(pq_to_linear(np.array([1.0]), 1.0)[0] - 10000) < 1
    assert (np.diff(pq_to_linear(np.arange(65536) / 65535, 203.0)) > 0).all()


def container(**more):
    c = DeflateCodec()
    return mux(MuxRequest(c.encode(8, 6, 3, bytes(144), 100), c.encode(4, 3, 1, bytes(12), 100), "apple", **more))


def test_blocks_by_magic():
    exif = S.write_tags([(274, 3, b"\6\0"), (700, 1, b"<x/>\0\0")], [(37386, 5, bytes(8))])
    assert M.exif_block(exif) == exif and M.xmp_of(exif) == b"<x/>"
    jpeg, left = M.wrapped(exif, b"iptc!", b"<y/>")
    assert left == [] and M.exif_block(jpeg) == exif and [(k, d) for k, _, d in M.sidecar(jpeg)] == [("xmp", b"<y/>"), ("iptc", b"iptc!")]
    heif = container(exif=exif, xmp=b"<z/>", opaque=(("uri ", "blob", b"1234"),))
    assert M.exif_block(heif) == exif and [(k, d) for k, _, d in M.sidecar(heif)] == [("xmp", b"<z/>"), ("item", b"1234")]
    assert M.exif_block(b"none of these") is None and list(M.sidecar(b"none of these")) == []
    assert M.wrapped(bytes(65_528)) == (None, ["exif"]) and M.wrapped(bytes(65_527))[1] == [] and M.wrapped() == (None, [])


def test_coded_picture():
    assert M.coded_image(container())[:4] == (8, 6, 3, 8)
    with pytest.raises(ValueError, match="grid"):
        M.coded_image(container().replace(b"hvc1", b"grid", 1))
    d = container(exif=b"II*\0")
    for n in range(len(d)):
        for read in (M.coded_image, M.exif_block, lambda x: list(M.sidecar(x))):
            try:
                read(d[:n])
            except (ValueError, IndexError):
                pass
