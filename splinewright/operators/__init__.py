"""The physical side: basis expansions, distributed passes, solvers and inference."""
