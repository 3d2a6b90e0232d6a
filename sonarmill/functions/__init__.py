"""Part of sonarmill; see README."""
