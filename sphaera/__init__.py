"""Manifold analytics on Spark: orientation binning, diffusion maps, sequence filtering, graph labelling, landscapes."""
