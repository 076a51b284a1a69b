"""License texts as they are usually written, and sentences that name another license or none."""

import textwrap

from veta.llm import licenses


def labels(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r.labels for r in sorted(licenses.scan(docs).collect(), key=lambda r: r.doc_id)]


def wrapped(text, before="", width=72):
    return "\n".join(before + line for line in textwrap.wrap(text, width))


def test_wrapped_texts_are_found(spark):
    long = [(label, t) for label, t in licenses.TEMPLATES if label.endswith("-text")]
    filler = " ".join(f"filler{i}" for i in range(licenses.STEP - 6))
    texts = [wrapped(t, before, 40) for _, t in long for before in ("", "// ", " * ")] + [filler + "\n" + wrapped(t, "# ") + "\n" + filler for _, t in long]
    want = [label for label, _ in long for _ in range(3)] + [label for label, _ in long]
    assert all(w in got.split(",") for w, got in zip(want, labels(spark, texts), strict=True))


def test_words_far_apart_are_no_template(spark):
    far = [" ".join(f"{w} " + " ".join(f"x{i}" for i in range(30)) for w in licenses.spelt(t).split()) for _, t in licenses.TEMPLATES]
    assert set(labels(spark, far)) == {""}


def test_other_licenses_and_prose_are_not_named(spark):
    texts = {
        "Released under the Apache License": "apache", "This project is licensed under the Apache License": "apache", "Licensed under CC BY 4.0": "cc-by",
        "Licensed under the Mozilla Public License, Version 2.0": "", "the album was released last year under a new license from the label": "",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License": "",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY": "",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "",
        " ".join(f"released x{i} y{i} under z{i} the v{i} license u{i}" for i in range(800)) + " far" * 30 + " mit": "",
    }
    assert labels(spark, list(texts)) == list(texts.values())


def test_templates_themselves_are_named(spark):
    got = labels(spark, [t for _, t in licenses.TEMPLATES] + ["Released under the terms of the MIT License", "Copyright (c) 1992, 1993 The Regents of the University. All rights reserved."])
    assert all(label in g.split(",") for label, g in zip([label for label, _ in licenses.TEMPLATES] + ["mit-notice", "rights-notice"], got, strict=True))
