"""All queries; importing the package registers them."""

from strandlab.plans import sequences, counting, context, statistics, motifs, models, graphs, evaluation, storage, streams  # noqa: F401, I001
