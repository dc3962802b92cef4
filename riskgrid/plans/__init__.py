"""The three end-to-end runs: model run, case generation, comparison."""
