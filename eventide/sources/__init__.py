"""Reading landed files and layers, writing layers, recording runs."""
