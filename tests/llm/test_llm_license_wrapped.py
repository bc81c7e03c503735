"""Notices that are wrapped over several lines, as license files have them."""

import random
import textwrap

import numpy as np

from tagspace.llm import license_scan

MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy\n"
       "of this software and associated documentation files (the \"Software\"), to deal\nin the Software")
BSD = ("Redistribution and use in source and binary forms, with or without\n"
       "modification, are permitted provided that the following conditions are met:\n")
ISC = ("# Permission to use, copy, modify, and/or distribute this software for any\n"
       "# purpose with or without fee is hereby granted, provided that")
CC = "Licensed under CC\nBY-NC 4.0"


def scanned(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in license_scan.license_scan(docs, **more).collect()}


def test_wrapped_notices(spark):
    notices = [("mit", MIT), ("bsd", BSD), ("isc", ISC), ("cc-by-nc", CC)]
    r = random.Random(1)
    texts, want = [], []
    for label, notice in notices:
        for before in (0, 3, 47, 48, 95, 700):
            pad = textwrap.fill(" ".join(f"w{r.randrange(50)}" for _ in range(before)), 60)
            texts += [f"{pad}\n{notice}\n{pad}"]
            want.append(label)
    for label, template in license_scan.TEMPLATES:
        for width in (12, 30, 60):
            texts.append("x y\n\n" + textwrap.fill(template, width, break_long_words=False).replace("\n", "\n * "))
            want.append(label)
    got = scanned(spark, texts)
    for i, label in enumerate(want):
        assert label in got[i].labels.split(",") and got[i].score >= 0.9, texts[i]


def test_words_far_apart_or_in_two_documents_are_no_notice(spark):
    far = ("zz\n" * 100).join(BSD.lower().split())
    first, second = BSD.split("\n")[:2]
    got = scanned(spark, [far, first, second])
    assert [(got[i].labels, got[i].score) for i in range(3)] == [("", 0.0)] * 3


def test_templates_longer_than_the_least_window(spark):
    long = " ".join(f"t{k}" for k in range(150))
    text = "w " * 40 + textwrap.fill(long, 50) + " w" * 40
    assert scanned(spark, [text], templates=[("own", long)])[0].labels == "own"


def test_windows_hold_every_passage():
    at = np.flatnonzero(np.random.Generator(np.random.PCG64(1)).random(3000) < 0.3)
    ranges = list(license_scan._windows(at, np.ones(len(at), bool), 96, 48))
    for p in range(at[0], at[-1] - 48):
        own = np.flatnonzero((at >= p) & (at < p + 48))
        assert not len(own) or any(a <= own[0] and own[-1] < b for a, b in ranges)
