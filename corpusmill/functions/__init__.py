"""Part of corpusmill; see the modules of this folder."""
