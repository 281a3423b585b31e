"""Gates of downloaded pictures, in order, and the best download of a candidate."""

from textloom.operators import images as I

FIELDS = "candidate_id long, pos int, url string, asked string, final string, status int, content_type string, bytes long, width int, height int, width_hint int, sharpness double, fit double, place string"
U = "https://img.example.org/p.jpg"


def one(id, pos=0, url=U, asked=U, final=None, status=200, kind="image/jpeg", size=50000, width=1200, height=675, hint=0, sharp=50.0, fit=0.5, place="body"):
    return (id, pos, url, asked, final, status, kind, size, width, height, hint, sharp, fit, place)


CASES = [
    (dict(), None), (dict(url="https://x.org/Logo.png"), "url_pattern_rejected"), (dict(url="https://x.org/logos.png"), None), (dict(asked="https://x.org/a.svg", status=404), "overlay_or_branding_url_rejected"), (dict(status=404, final="https://x.org/a.svg"), "download_failed"),
    (dict(status=None), "download_failed"), (dict(final="https://x.org/a.svg", kind="text/html"), "overlay_or_branding_url_rejected"), (dict(kind="text/html", width=None), "non_image_content"), (dict(kind=None), None), (dict(kind="", width=None, hint=900), "unknown_dimensions"),
    (dict(width=None, height=None, hint=900), None), (dict(width=None, hint=900, size=14999), "unknown_dimensions"), (dict(width=399), "resolution_too_low"), (dict(height=219, size=1), "resolution_too_low"), (dict(size=14999), "file_too_small"),
    (dict(size=None, width=1000, height=900), None), (dict(width=2000, height=500), "extreme_aspect_ratio"), (dict(width=800, height=250), None), (dict(sharp=5.9, fit=0.0), "blur_detected"), (dict(sharp=None), "blur_detected"), (dict(fit=0.09), "low_relevance"), (dict(fit=None, place="og:image"), None), (dict(width=70000, height=70000), None),
]


def test_each_gate(spark):
    rows = spark.createDataFrame([one(k, **case) for k, (case, _) in enumerate(CASES)], FIELDS)
    got = {r.candidate_id: r for r in I.probed(rows).collect()}
    assert {k: got[k].reason for k in got} == {k: why for k, (_, why) in enumerate(CASES)} and all(r.ok == (r.reason is None) for r in got.values())
    assert (got[10].width, got[10].height) == (900, 508)


def test_best_download_and_most_telling_reason(spark):
    rows = [
        one(1, 0, width=600, height=400), one(1, 1), one(1, 2), one(1, 3, sharp=1.0), one(2, 0, status=500), one(2, 1, sharp=1.0), one(2, 2, width=100), one(None, 0), one(None, 1, status=404), one(3, 0, width=5000, height=400), one(3, 0, width=5000, height=400),
    ]
    got = {r.candidate_id: r for r in I.probed(spark.createDataFrame(rows, FIELDS)).collect()}
    assert (got[1].ok, got[1].pos, got[1].reason) == (True, 1, None) and abs(got[1].score - (1200 * 675 / 1920 / 1080 * 0.48 + 0.11 + 0.12 + 0.09)) < 1e-9
    assert (got[2].ok, got[2].pos, got[2].reason) == (False, None, "resolution_too_low") and got[3].reason == "extreme_aspect_ratio" and got[None].pos == 0
    assert I.probed(spark.createDataFrame([], FIELDS)).collect() == []
