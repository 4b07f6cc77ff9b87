"""Row-level operators on streaming inputs."""
