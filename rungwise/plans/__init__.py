from rungwise.plans import colour, extras, files, indices, reports, samples, streams  # noqa: F401
