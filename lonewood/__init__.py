"""lonewood: isolation-forest anomaly scoring as Spark jobs.

    from lonewood import fit, load_model
    model = fit(df, features=["a", "b"], id_col="id", n_trees=100, psi=256, seed=7)
    scored = model.score(df, id_col="id")
"""

__version__ = "0.1.0"

from .operators.forest import ForestModel, fit, load_model, tree_samples  # noqa: E402,F401
from .sources.bundle import fit_score_save, load_bundle, save_bundle, save_model  # noqa: E402,F401
from .streaming.scoring import score_stream, write_scores  # noqa: E402,F401
