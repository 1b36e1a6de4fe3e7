"""Issue detectors. Each returns package, version, repo, errno, level, filename, detail."""
