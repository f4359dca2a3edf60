"""Reading inputs, writing results, and saved artefacts."""
