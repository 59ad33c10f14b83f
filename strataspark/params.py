"""Parameters of a classification; defaults are the documented ones."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    # The documented defaults, which results depend on.
    tile_size: float = 100.0
    buffer_m: float = 5.0
    ground_source: str = "compute"  # compute | from_file
    ground_method: str = "csf"  # csf | grid
    surface_lookup: str = "nearest"  # nearest | bilinear
    ground_cell_size: float = 0.5
    ground_threshold: float = 0.50
    smooth_passes: int = 5
    csf_cloth_resolution: float = 0.30
    csf_class_threshold: float = 0.05
    csf_rigidness: int = 1
    csf_iterations: int = 1000
    csf_slope_smooth: bool = True
    csf_voxel_size: float = 0.10
    nz_min: float = 0.02
    nz_max: float = 0.40
    dbscan_eps: float = 0.30
    dbscan_min_pts: int = 8
    max_footprint_m2: float = 1.0
    min_footprint_m2: float = 0.005
    candidate_share: float = 0.05
    classify_vegetation: bool = True
    veg_low_min: float = 0.10
    veg_low_max: float = 1.00
    veg_med_max: float = 3.00
    noise_below_ground: float = -0.10
    probable_ground_band: float = 0.0
    classify_model_keys: bool = False
    modelkey_step_m: float = 8.0
    point_cloud_source: str = "lidar"  # lidar | photogrammetry | slam
    vegetation_index: str = "auto"  # auto | ndvi | vari | exg
    ndvi_threshold: float = 0.20
    vari_threshold: float = 0.15
    exg_threshold: float = 15.0
    detect_buildings: bool = True
    building_min_area_m2: float = 20.0
    building_min_height_agl: float = 2.5
    building_plane_threshold: float = 0.10
    building_cluster_eps: float = 1.0
    building_min_cluster_pts: int = 300
    slam_zgrid_smooth_cells: int = 3
    slam_z_range_max: float = 0.50
    mask_before_ground: bool = False

    def for_source(self) -> Params:
        """The cloth's parameters of the photogrammetry and SLAM modes."""
        if self.point_cloud_source == "photogrammetry":
            return replace(self, csf_cloth_resolution=2.0, csf_class_threshold=0.05, csf_rigidness=3, csf_iterations=500)
        if self.point_cloud_source == "slam":
            return replace(self, csf_cloth_resolution=0.50, csf_class_threshold=0.20, csf_rigidness=1, csf_iterations=500)
        return self
