"""Work made of several operators: zonal report, derived cubes, sync."""
