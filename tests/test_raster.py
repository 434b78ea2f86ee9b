import math

import numpy as np
import pytest

from glyphloom.config import GenerationConfig
from glyphloom.functions import charsets, draws
from glyphloom.operators import backgrounds
from glyphloom.plans import generate
from glyphloom.raster import image, ttf
from glyphloom.sources import binary, sinks

FONTS = "/usr/share/fonts/truetype/dejavu"
DATA = open(f"{FONTS}/DejaVuSans.ttf", "rb").read()


def draw(name):
    return draws.value(1, name)


def test_glyph_area():
    plane = ttf.render(DATA, "l", 40, False, 3)
    assert plane[:3].max() == 0 and plane[:, :3].max() == 0 and plane.max() == 255
    assert ttf.render(DATA, "l", 40, True, 3).sum() > plane.sum()
    assert ttf.render(DATA, " ", 40, False, 2).shape == (4, 4)


def test_square_coverage():
    line = np.array([(1.5, 1.25), (4.0, 1.25), (4.0, 3.0), (1.5, 3.0)])
    found = ttf.coverage([line], 6, 5)
    assert math.isclose(found.sum(), 2.5 * 1.75, abs_tol=1e-9)
    assert math.isclose(found[1, 1], 0.5 * 0.75, abs_tol=1e-9) and found[2, 2] == 1 and found[4].sum() == 0


def test_slanted_coverage():
    triangle = np.array([(0.3, 0.2), (7.7, 2.9), (1.1, 4.8)])
    (x, y), (u, v) = triangle[1] - triangle[0], triangle[2] - triangle[0]
    assert math.isclose(ttf.coverage([triangle], 9, 6).sum(), abs(x * v - y * u) / 2, rel_tol=1e-9)


def test_bad_font():
    with pytest.raises(ttf.FontError):
        ttf.Font(b"no font at all")


def test_gates_and_sizes():
    plane = ttf.render(DATA, "gate", 24, False, 4)
    for kind in (image.RandomRotate, image.RandomBlur, image.RandomPerspective):
        assert kind(prob=0.0)(plane, draw) is plane
        assert kind.__name__ in repr(kind())
    assert image.RandomRotate((45, 45), 1.0)(plane, draw).shape != plane.shape
    assert image.RandomPerspective(3, 1.0)(plane, draw).shape == plane.shape
    assert image.RandomBlur((0.3, 1.0), 1.0)(plane, draw).shape == plane.shape
    swap = lambda p, d: p.T
    assert (image.AugmentationPipeline((swap, swap))(plane, draw) == plane).all()
    assert image.rotated_size(30, 10, 90) == (10, 30)
    assert (image.rotate(plane, 0) == plane).all()


def test_coefficients():
    source, target = [(0, 0), (1, 0), (1, 1), (0, 1)], [(0, 0), (2, 0), (2, 2), (0, 2)]
    c = image.find_coefficients(source, target)
    assert c.shape == (8,) and np.allclose(c, [2, 0, 0, 0, 2, 0, 0, 0], atol=1e-9)


def test_compose_and_png():
    rng = np.random.default_rng(0)
    crop = rng.integers(0, 256, (9, 13, 3), dtype=np.uint8)
    alpha = rng.integers(0, 256, (9, 13), dtype=np.uint8)
    made = image.compose(alpha, crop, 0.5)
    assert (made[..., 3] == 255).all()
    none = image.compose(np.zeros_like(alpha), crop, 0.5)
    assert (none[..., :3] == crop).all()
    with pytest.raises(ValueError):
        image.visible_ratio(np.zeros((0, 0)))
    assert image.visible_ratio(np.array([[20, 21]])) == 0.5


def test_charsets():
    sets = charsets.registry()
    assert all(len(v) == len(set(v)) for v in sets.values())
    assert sets["english"] == sets["latin"] + "°" + sets["currency"]
    assert "w" not in sets["bosnian"] and "č" in sets["bosnian"]
    assert set(sets["french"]) <= set(sets["multilingual"])
    assert charsets.registry({"digits": "01"})["latin"].startswith("01abc")


def test_configuration():
    with pytest.raises(ValueError):
        GenerationConfig("w", "f", "o", 1, val_percent=1.5)
    with pytest.raises(ValueError):
        GenerationConfig("w", "f", "o", 1, max_attempts=0)


def test_whole_run(spark, tmp_path):
    (tmp_path / "words.txt").write_text("one\ntwo\n一丁\nÀé\n", encoding="utf-8")
    (tmp_path / "bg").mkdir()
    (tmp_path / "bg/a.png").write_bytes(image.png(np.full((80, 300, 3), 120, np.uint8)))
    (tmp_path / "bg/broken.png").write_bytes(b"no picture")
    config = GenerationConfig(str(tmp_path / "words.txt"), FONTS, str(tmp_path / "out"), 10, str(tmp_path / "bg"), seed=4)
    shown = []
    found = {r.split: r for r in generate.generate(spark, config, show=shown.append).collect()}
    assert set(found) == {"train", "val"}
    assert shown and "images" in shown[-1] and "a second" in shown[-1]
    import json

    for split in found:
        labels = json.loads((tmp_path / f"out/{split}/labels.json").read_text(encoding="utf-8"))
        files = {p.name for p in (tmp_path / f"out/{split}/images").glob("*.png")}
        assert set(labels) == files and len(files) == found[split].n_success
        assert {"one", "two", "Àé"} <= set(labels.values())


def test_pictures_of_all_kinds(spark, tmp_path):
    """JPEG and PNG of several depths, decoded on the JVM; what is no picture, and what is too small, is never used."""
    jvm, kind = spark._jvm, spark._jvm.java.awt.image.BufferedImage
    for name, form, of in (("a.jpg", "jpg", kind.TYPE_INT_RGB), ("b.png", "png", kind.TYPE_INT_ARGB), ("c.PNG", "png", kind.TYPE_BYTE_INDEXED), ("d.jpeg", "jpg", kind.TYPE_BYTE_GRAY), ("e.png", "png", kind.TYPE_USHORT_GRAY)):
        picture = jvm.java.awt.image.BufferedImage(6, 4, of)
        for x in range(6):
            for y in range(4):
                picture.setRGB(x, y, (255 << 24) - (1 << 32) + (200 << 16) + (100 << 8) + 50)
        assert jvm.javax.imageio.ImageIO.write(picture, form, jvm.java.io.File(str(tmp_path / name)))
    (tmp_path / "f.png").write_bytes(b"not an image")
    (tmp_path / "g.txt").write_bytes((tmp_path / "b.png").read_bytes())
    found = binary.backgrounds(spark, str(tmp_path)).sort("bg_idx").collect()
    assert [r.path.rsplit("/", 1)[1] for r in found] == ["a.jpg", "b.png", "c.PNG", "d.jpeg", "e.png", "f.png"] and [r.bg_idx for r in found] == list(range(6))
    assert [(r.width, r.height) for r in found] == [(6, 4)] * 5 + [(0, 0)]
    made = [image.pixels(bytes(r.content), r.width, r.height, r.channels) for r in found]
    assert made[5] is None and all(m.shape == (4, 6, 3) for m in made[:5])
    assert all(np.abs(m.astype(int) - [200, 100, 50]).max() <= 5 for m in made[:3])
    (tmp_path / "own").mkdir()
    whole = np.random.default_rng(0).integers(0, 256, (9, 13, 3), dtype=np.uint8)
    (tmp_path / "own/x.png").write_bytes(image.png(whole))
    r = binary.backgrounds(spark, str(tmp_path / "own")).first()
    assert (image.pixels(bytes(r.content), r.width, r.height, r.channels) == whole).all()


def test_small_background_and_none(spark, tmp_path):
    """Crops are white where no picture is large enough, and, with a warning, where there is none."""
    (tmp_path / "bg").mkdir()
    (tmp_path / "bg/small.png").write_bytes(image.png(np.zeros((5, 5, 3), np.uint8)))
    tasks = spark.createDataFrame([(1, 50, 50)], "key long, w int, h int")
    assert backgrounds.crop_plan(tasks, binary.backgrounds(spark, str(tmp_path / "bg")), 1).first() == (1, 50, 50, None, None, None)
    (tmp_path / "empty").mkdir()
    for folder in (None, str(tmp_path / "empty")):
        with pytest.warns(UserWarning, match="no background pictures"):
            none = binary.backgrounds(spark, folder)
        assert backgrounds.crop_plan(tasks, none, 1).first() == (1, 50, 50, None, None, None)


def test_crop_plans_agree(spark, monkeypatch):
    tasks = spark.range(200).selectExpr("id AS key", "CAST(5 + id % 60 AS INT) AS w", "CAST(3 + id % 20 AS INT) AS h")
    pictures = spark.createDataFrame([(0, 20, 20), (1, 64, 30), (2, 0, 0), (3, 9, 9)], "bg_idx int, width int, height int")
    made = []
    for most in (4096, 0):
        monkeypatch.setattr(backgrounds, "IN_PLAN", most)
        made.append(sorted(map(tuple, backgrounds.crop_plan(tasks, pictures, 5).collect()), key=str))
    assert made[0] == made[1] and {r[3] for r in made[0]} == {None, 0, 1, 3}


def test_rate():
    assert sinks.rate_and_eta(50, 200, 10) == (5.0, 30.0) and sinks.rate_and_eta(0, 200, 10) == (0.0, None)


def test_custom_augmentations(spark):
    own = binary.fonts(spark, FONTS).where("font_path like '%DejaVuSans.ttf'")
    tasks = spark.createDataFrame([("train", 0, "0.png", "word", own.first().font_path)], generate.PLAN)
    turned = generate.render(tasks, own, GenerationConfig("", FONTS, "", 1), augmentations=(lambda p, d: p.T,)).first()
    plain = generate.render(tasks, own, GenerationConfig("", FONTS, "", 1), augmentations=(lambda p, d: p,)).first()
    assert (turned.width, turned.height) == (plain.height, plain.width)


def test_images_do_not_depend_on_partitions(spark, tmp_path, monkeypatch):
    own = binary.fonts(spark, FONTS).where("font_path like '%DejaVuSans.ttf'")
    path = own.first().font_path
    rows = [("train", k, f"{k}.png", w, path if w != "x" else None) for k, w in enumerate(["a", "word", "x", "Ünï"])]
    rng = np.random.default_rng(1)
    for name, (h, w) in {"a": (60, 200), "b": (90, 300), "small": (5, 5)}.items():
        (tmp_path / f"{name}.png").write_bytes(image.png(rng.integers(0, 256, (h, w, 3), dtype=np.uint8)))
    pictures = binary.backgrounds(spark, str(tmp_path))
    for backgrounds in (None, pictures):
        made = []
        for parts, most, font_rows, in_plan in ((1, generate.MOST_SENT, 20_000, 4096), (3, generate.MOST_SENT, 20_000, 0), (2, -1, 1, 4096)):
            tasks = spark.createDataFrame(rows, generate.PLAN).repartition(parts)
            monkeypatch.setattr(generate, "MOST_SENT", most)
            monkeypatch.setattr(generate, "FONT_ROWS", font_rows)
            monkeypatch.setattr(generate.crops, "IN_PLAN", in_plan)
            made.append(sorted((r.idx, r.success, bytes(r.png or b"")) for r in generate.render(tasks, own, GenerationConfig("", FONTS, "", 4), backgrounds).collect()))
        assert made[0] == made[1] == made[2]
        assert [r[1] for r in made[0]] == [True, True, False, True]


def test_stream(spark, tmp_path):
    from glyphloom.streaming import wordlists

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("a\nb\n")
    for _ in range(2):
        wordlists.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), 4).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.where("batch = 0").select("split", "word").distinct().count() == 4


@pytest.mark.parametrize("name", ["DejaVuSans.ttf", "DejaVuSansMono-Bold.ttf", "DejaVuSerif.ttf"])
def test_characters_and_advances_as_java_has_them(spark, name):
    """Character maps and advances against the JVM's own reading of the fonts."""
    jvm = spark._jvm
    data, size = open(f"{FONTS}/{name}", "rb").read(), 2048.0
    font = ttf.Font(data)
    java = jvm.java.awt.Font.createFont(0, jvm.java.io.File(f"{FONTS}/{name}")).deriveFont(size)
    own = {ord(c) for c in font.characters()}
    sample = [p for p in range(0x21, 0x3000, 7) if not 0x7F <= p < 0xA0 and not 0x200B <= p <= 0x206F and p != 0xAD]
    assert [p for p in sample if (p in own) != java.canDisplay(p)] == []
    lines = jvm.java.awt.font.FontRenderContext(None, True, True)
    for p in [p for p in sample if p in own and chr(p).isalpha()][::5]:
        advance = java.createGlyphVector(lines, chr(p)).getGlyphMetrics(0).getAdvanceX()
        assert abs(advance - font.advance(font.cmap[p]) * size / font.units) < 1, hex(p)


def test_fonts_without_outlines(spark, tmp_path):
    """A font of another kind of outlines is matched with no word, and a broken one neither."""
    data = bytearray(DATA)
    at = data.index(b"glyf", 12)
    data[at : at + 4] = b"CFF "
    (tmp_path / "a.otf").write_bytes(bytes(data))
    (tmp_path / "b.ttf").write_bytes(b"junk")
    found = binary.font_support(binary.fonts(spark, str(tmp_path))).collect()
    assert len(found) == 2 and all(r.chars == [] and r.error for r in found)
